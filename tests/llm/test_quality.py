import math
import random
from collections import Counter

from quillmesh.llm import quality as Q

PROSE = {
    "en": "There was an old mill near the river, and later a teacher from the town supported it for nine years. Although it burned down before the war, the people of the valley rebuilt it at the request of the council. ",
    "de": "Die alte Mühle war lange Zeit geschlossen, aber es gab keine Hilfe, weil das Geld fehlte. Es ist bekannt, dass sie nach dem Krieg mit der Familie in die Stadt zog und dort bis zum Ende blieb. ",
    "fr": "La ville était pauvre, mais on sait que le théâtre a été ouvert après la guerre. Il est certain que la famille est revenue de Paris et y resta jusqu'à la fin, car il y avait du travail pour les deux. ",
    "es": "Es cierto que la ciudad era pobre, y la familia vivió en el valle hasta el final de la guerra. Después de los años se abrió un teatro en el centro, que era nuevo para los vecinos, pero no se quedó. ",
}
RNG = random.Random(4)
NAMES = ["Ann Lee", "Mount Plodrabar", "University of Skubrotek", "One Bridge in Tal", "Football Club Wyk", "Bob Ray", "The Silent Garden of Zwid"]
JUNK = {
    "list": "\n".join(f"{i}) {RNG.choice(NAMES)}" for i in range(40)),
    "line list": ", ".join(RNG.choice(NAMES) for _ in range(60)),
    "table": "\n".join(f"{RNG.randint(1, 28)} May 1950\t{RNG.choice(NAMES)}\t{RNG.randint(0, 5)}-{RNG.randint(0, 5)}\t{RNG.randint(100, 9999)}" for _ in range(30)),
    "box": "\n".join(f"{k}: {RNG.choice(NAMES)}" for k in ["Name", "Born", "Club", "Spouse", "Residence"] * 4),
    "base64": "".join(RNG.choices("ABCDEFabcdefghij0123456789+/", k=900)),
    "letters": " ".join("".join(RNG.choices("bcdfghjklmnpqrstvwxz", k=RNG.randint(5, 11))) for _ in range(90)),
    "numbers": " ".join(str(RNG.random())[:6] for _ in range(120)),
    "markup": "\n".join("{{cell|c=%d|style=#%06x;}}" % (i, i * 999) for i in range(40)),
}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, g, 1.0) for i, (t, g) in enumerate(docs)], "doc_id bigint, text string, lang string, common_share double")


def test_prose_and_junk(spark):
    docs = [(PROSE[g] * n, g) for g in PROSE for n in (1, 2, 5)] + [(PROSE["en"].upper(), None), (PROSE["en"].lower(), "xx"), ("\n".join(PROSE["de"].split(" ")), "de")] + [(PROSE["en"].replace(" ", "\n", 20), "en")]
    junk = [(t, "en") for t in JUNK.values()] + [("A short note was here.\n\n" + t, "en") for t in JUNK.values()]
    rows = {r.doc_id: r for r in Q.prose_report(frame(spark, docs + junk)).collect()}
    assert [i for i in range(len(docs)) if not rows[i].is_prose] == []
    assert [i for i in range(len(docs), len(docs) + len(junk)) if rows[i].is_prose] == []
    assert [rows[i].lang for i in range(0, 12, 3)] == list(PROSE)


def test_statistics(spark):
    r = Q.document_stats(frame(spark, [('He was 12.\n\n(ok)\n', "EN-gb")])).first()
    assert (r.lang, r.n_chars, r.n_words) == ("en", 17, 3)
    assert math.isclose(r.mean_word, 7 / 3) and math.isclose(r.symbol_share, 5 / 12) and math.isclose(r.digit_share, 2 / 12)
    assert r.line_end_share == 0.5 and math.isclose(r.common_share, 2 / 3) and r.line_words == 1.5


def test_outlier_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["en", "de"]), float(rng.randint(0, 5)), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, a double, b double")
    got = {r.doc_id: r for r in Q.outlier_scores(df, ("a", "b")).collect()}
    for i, g, *vals in rows:
        same = [r for r in rows if r[1] == g]
        lo = [-math.log(sum(r[2 + k] <= v for r in same) / len(same)) for k, v in enumerate(vals)]
        hi = [-math.log(sum(r[2 + k] >= v for r in same) / len(same)) for k, v in enumerate(vals)]
        assert math.isclose(got[i].low, sum(lo), abs_tol=1e-9) and math.isclose(got[i].high, sum(hi), abs_tol=1e-9)
        assert math.isclose(got[i].score, max(sum(lo), sum(hi), sum(map(max, lo, hi))), abs_tol=1e-9)


def test_bad_rows(spark):
    rows = {r.doc_id: r for r in Q.prose_report(frame(spark, [(None, None), ("", "en"), (" \n ", ""), ("x" * 500_000, None), (PROSE["en"] * 1500, None)])).collect()}
    assert len(rows) == 5 and rows[0].n_words == 0 and rows[4].is_prose and rows[4].n_words > 50_000
    assert Q.prose_report(frame(spark, [])).isEmpty()
    assert Counter(r.lang for r in rows.values())["und"] >= 2


def test_copies_and_lone_junk_are_no_prose(spark):
    """Copies of one text tie in every statistic, and a text that is alone in its language ties with itself."""
    docs = [(JUNK["box"], "en")] * 9 + [(PROSE["en"], "en")] + [(JUNK["base64"], None)] + [(PROSE["de"], "de")] * 2
    rows = {r.doc_id: r for r in Q.prose_report(frame(spark, docs)).collect()}
    assert [i for i, r in sorted(rows.items()) if r.is_prose] == [9, 11, 12]
    assert len({rows[i].score for i in range(9)}) == 1 and rows[0].score > 0 and rows[10].score > 0


def test_names_with_a_common_word_are_no_sentences(spark):
    box = "Name: René Mrebrikel\nAwards: 2x Kareldian War\nDied: 10 December 1885\nSpouse: Edward Slaslelek\nKnown for: Hidden Mybbelor"
    french = ", ".join(f"{x} de la {y}" for x in ("Rue", "Pont", "Club", "Ligue") for y in ("Mer", "Tour", "Paix", "Gare", "Croix"))
    spanish = "\n".join(f"{x} de los {y}" for x in ("Casa", "Plaza", "Club", "Liga") for y in ("Reyes", "Santos", "Llanos"))
    prose = ["The mill has 16 members.", "Deborah Dryggikal resigned in 1858 and founded the shipyard of Hesobek.", PROSE["fr"], PROSE["es"]]
    rows = Q.prose_report(frame(spark, [(t, "en") for t in (box, french, spanish, *prose)])).collect()
    assert sorted(r.doc_id for r in rows if not r.is_prose) == [0, 1, 2]


def test_the_ranks_decide(spark):
    """Lists are told from prose whatever their share; a document whose statistics contradict each other goes where it is
    less at home, which is for the other documents of its language to say."""
    rng = random.Random(2)
    row = lambda i, sent, telling: (i, "en", sent, telling)
    prose = [row(i, rng.uniform(0.9, 1.0), rng.uniform(0.15, 0.3)) for i in range(1000)]
    lists = [row(2000 + i, rng.uniform(0.0, 0.1), rng.uniform(0.0, 0.04)) for i in range(1000)]

    def odd(rows):
        return {r.doc_id for r in Q.prose_scores(spark.createDataFrame(rows, "doc_id bigint, lang string, sentence_share double, telling_share double")).where("score >= threshold").collect()}

    for some in (lists, lists[:10], lists[:1]):
        assert odd(prose + some) == {r[0] for r in some}
    assert odd(prose) == set() and odd(lists) == {r[0] for r in lists} and odd([]) == set()
    mixed = row(5000, 0.2, 0.12)
    partly = [row(8000 + i, rng.uniform(0.0, 0.5), rng.uniform(0.0, 0.04)) for i in range(1000)]
    loose = [row(6000 + i, rng.uniform(0.5, 1.0), rng.uniform(0.1, 0.3)) for i in range(1000)]
    terse = [row(7000 + i, rng.uniform(0.9, 1.0), rng.uniform(0.07, 0.11)) for i in range(1000)]
    assert 5000 in odd(loose + partly + [mixed]) and 5000 not in odd(prose + lists[:100] + terse + [mixed])


def test_scores_against_brute_force(spark):
    rng = random.Random(3)
    names = list(Q.BOUNDARY)
    rows = [(i, rng.choice(["en", "de"]), *(rng.choice([0.0, 1.0, round(rng.random(), 2)]) for _ in names)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, " + ", ".join(f"{n} double" for n in names))
    got = {r.doc_id: r for r in Q.prose_scores(df).collect()}
    assert len(got) == 300 and len({r.is_prose for r in df.sparkSession.createDataFrame([(r.score < r.threshold,) for r in got.values()], "is_prose boolean").collect()}) == 2

    def score(values, same):
        total = 0.0
        for k, (_, side, weight) in enumerate(Q.BOUNDARY.values()):
            below, ties = sum(r[2 + k] < values[k] for r in same), sum(r[2 + k] == values[k] for r in same)
            middle = below + ties / 2
            total -= weight * math.log(((middle if side < 0 else len(same) - middle) + 0.5) / (len(same) + 1))
        return total

    for r in rows:
        same = [x for x in rows if x[1] == r[1]]
        assert math.isclose(got[r[0]].score, score(r[2:], same), abs_tol=1e-8)
        assert math.isclose(got[r[0]].threshold, score([v for v, _, _ in Q.BOUNDARY.values()], same), abs_tol=1e-8)
