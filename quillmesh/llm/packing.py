"""Items of varying size packed into containers of fixed capacity.

Sizes are counted in tokens of a public tokenizer. Packing works on the histogram of sizes, which has at most as many
rows as the capacity, whatever the number of documents: sizes are placed longest first, each into the open pattern with
the least room left that still takes it, updating how many containers have which pattern. Patterns and documents then
meet by rank: the documents of one size are numbered exactly, by range partitions, and a pattern owns an interval of
these numbers.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.skew import range_rank
from quillmesh.session import cut

CAPACITY = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the public byte-level vocabulary splits a text before merging.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a ranks file; read once a Python worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row with an id; a null or empty text has 0 tokens. Whole texts are tokenized."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in batch["t"]]})

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
    return source.mapInPandas(count, "doc_id bigint, n_tokens bigint")


@dataclass
class Segment:
    """Containers base .. base + count - 1 hold `each` items of a size; these are the items start .. start + each * count - 1 of that size."""

    size: int
    start: int
    each: int
    base: int
    count: int


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Shortest-pack-first packing of a histogram of sizes 1 .. capacity; gives the segments and the number of containers.

    A pattern is a run of containers that are filled alike. Sizes come longest first; each item goes into the container
    with the most room left, if it fits there, else into a new one. Containers with as much room are served together: a
    step gives each of them one item, and cuts the run in two where fewer are needed.
    """
    room: dict[int, list[list[int]]] = defaultdict(list)  # room left -> runs of [base, count]
    emptiest: list[int] = []  # a heap of -room, with rooms that may be used up
    segments: list[Segment] = []
    used = 0

    def put(space: int, base: int, count: int) -> None:
        if space:
            if not room[space]:
                heapq.heappush(emptiest, -space)
            room[space].append([base, count])

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        assert 0 < size <= capacity
        left, start = histogram[size], 0
        while left:
            while emptiest and not room[-emptiest[0]]:
                heapq.heappop(emptiest)
            space = -emptiest[0] if emptiest else 0
            if space >= size:
                base, count = room[space].pop()
                each, take = 1, min(count, left)
                if take < count:
                    room[space].append([base + take, count - take])
            else:
                # nothing fits, so a new container has the most room until it is full
                space, base, each = capacity, used, min(capacity // size, left)
                take = left // each
                used += take
            segments.append(Segment(size, start, each, base, take))
            put(space - each * size, base, take)
            left, start = left - each * take, start + each * take
    return segments, used


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part_no, n_parts, n_tokens, container) for (doc_id, n_tokens).

    A document within the capacity is one part. A larger one is cut into parts of the capacity and a rest; only these are
    cut. Documents without tokens take no room and get no container (null). Every part is in exactly one container and no
    container holds more than the capacity. The driver sees the histogram (at most `capacity` rows) and the segments made
    from it, never documents. Ids must be unique.
    """
    n = F.col("n_tokens")
    parts = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    cutting = sizes.select("doc_id", n.alias("whole"), parts.alias("n_parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part_no"))
    items = cut(cutting.select("doc_id", "part_no", "n_parts", F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("part_no") * capacity).alias("n_tokens")))
    histogram = {r[0]: r[1] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    segments, _ = pack_histogram(histogram, capacity)
    firsts, before = {}, 0
    for size in sorted(histogram):
        firsts[size] = before
        before += histogram[size]
    # segments own intervals of ranks, without gaps; in order of their first rank
    owned = sorted((firsts[s.size] + s.start, s.each, s.base) for s in segments)
    lo, each, base = (np.array(x, np.int64) for x in (zip(*owned) if owned else ((), (), ())))

    @F.pandas_udf("bigint")
    def container(rank: pd.Series) -> pd.Series:
        at = rank.to_numpy(np.int64) - 1
        k = np.searchsorted(lo, at, side="right") - 1
        return pd.Series(base[k] + (at - lo[k]) // each[k])

    ranked = range_rank(items.where("n_tokens > 0"), [F.col("n_tokens"), F.col("doc_id"), F.col("part_no")])
    placed = ranked.select("doc_id", "part_no", "n_parts", "n_tokens", container("rank").alias("container"))
    return placed.unionByName(items.where("n_tokens <= 0").select("*", F.lit(None).cast("bigint").alias("container")))
