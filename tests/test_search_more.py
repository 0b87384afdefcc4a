"""Stems, pruned search and tables of needles: published pairs, and comparisons with plain code and with the unpruned search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions.stems import english, stems
from codestrata.operators import pruned, search
from codestrata.operators.ranking import cut

# Words and their stems from the published sample vocabulary of the algorithm.
PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol
consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
# Worked out from the rules, a few for every step.
RULES = """
caresses caress ties tie cries cri gas gas gaps gap kiwis kiwi status status dress dress bias bias skies sky dying die news news
agreed agre feed feed plastered plaster bled bled motoring motor sing sing luxuriated luxuri sized size disabled disabl
hopping hop hoping hope falling fall filing file fizzed fizz failing fail inning inning proceed proceed exceeds exceed
happy happi cry cri by by say say boyish boyish youth youth relational relat conditional condit rational ration valency valenc
hesitancy hesit digitizer digit conformably conform radically radic differently differ vilely vile analogously analog
organization organ predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formality formal sensitivity sensit sensibility sensibl apology apolog triplicate triplic formative format formalize formal
electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt communism communism activate activ angularity angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas roll roll generate generat generously generous communication communic arsenal arsenal
handlers handler handle handl handles handl handled handl handling handl queries queri query queri routes rout routing rout
authentication authent authenticated authent parser parser parsers parser parsing pars caches cach cached cach caching cach
""".split()


@pytest.mark.parametrize("words", [PAIRS, RULES], ids=["published", "rules"])
def test_stems(words):
    kept = {"by"}  # a stop word, listed for its last letter
    assert [(w, english(w)) for w in words[::2] if w not in kept] == [(w, s) for w, s in zip(words[::2], words[1::2], strict=True) if w not in kept]


def test_words_that_are_not_stemmed():
    assert [english(w) for w in ("the", "themselves", "now", "is")] == [None] * 4
    assert [english(w) for w in ("x", "go", "md5s", "2ies", "états", "")] == ["x", "go", "md5s", "2ies", "états", ""]


def test_stems_of_a_column(spark):
    words = spark.createDataFrame([(w,) for w in [*PAIRS[::2], "the", "x1s"] * 3] + [(None,)], "word string").repartition(3)
    got = {(r.word, r.stem) for r in words.select("word", stems(F.col("word")).alias("stem")).collect()}
    assert got == set(zip(PAIRS[::2], PAIRS[1::2], strict=True)) | {("the", None), ("x1s", "x1s"), (None, None)}


ENTITIES = "repository_id string, id long, symbol_name string, file_path string, content string"


def test_an_inflected_question_finds_the_name(spark):
    entities = spark.createDataFrame([("r", 1, "handleRequest", "src/a.ts", "the caches of them"), ("r", 2, "other", "src/b.ts", "Handlers, handled"), ("r", 3, "hand", "src/c.ts", "")], ENTITIES)
    questions = spark.createDataFrame([("r", 7, ["handles", "caching", "the"])], "repository_id string, question_id long, terms array<string>")
    found = lambda stem: {r.id: round(r.score, 6) for r in search.term_top_k(questions, search.postings(entities, stem), stem=stem).collect()}
    # "handlers" has a stem of its own, as the rules have it
    assert found("english") == {1: 1.2, 2: 0.2}
    assert found(None) == {1: 0.2}
    terms = {(r.id, r.term): r.tf for r in search.postings(entities).collect()}
    assert terms[2, "handler"] == terms[2, "handl"] == 2 and (1, "the") not in terms and (1, "them") not in terms


def test_words_stay_as_they_are_without_a_stemmer(spark):
    entities = spark.createDataFrame([("r", 1, "the handlers", "a/b.ts", "handles handled 12 handles")], ENTITIES)
    assert {r.term: r.tf for r in search.postings(entities, None).where("weight < 0.5").collect()} == {"handles": 4, "handled": 2, "12": 2}


def _terms(spark, rng):
    """Weights of very unequal size, many equal ones, one term that every entity holds, one large and some small repositories."""
    index, asked = [], []
    for repository, n in (("hot", 900), ("small", 30), ("one", 1)):
        for i in range(n):
            scale = rng.choice([1, 1, 1, 4, 60])
            index += [(repository, i, f"w{t}", round(0.1 * scale * rng.randrange(1, 4), 6)) for t in range(20) if t == 0 or rng.random() < 0.15]
        asked += [(repository, 100 * n + q, [f"w{rng.randrange(22)}" for _ in range(rng.randrange(5))]) for q in range(25)]
    return (spark.createDataFrame(asked, "repository_id string, question_id long, terms array<string>"),
            spark.createDataFrame(index, "repository_id string, id long, term string, weight double").repartition(5))


def _hits(df):
    return sorted((r.repository_id, r.question_id, r["rank"], r.id, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("k", [1, 9, 40])
def test_pruned_terms_are_the_same_rows(spark, k):
    questions, index = _terms(spark, random.Random(1))
    hits, _ = pruned.term_top_k_pruned(questions, *pruned.impact_blocks(index, 20), k, stem=None, question_block=6)
    assert _hits(hits) == _hits(search.term_top_k(questions, index, k, stem=None))


def test_fewer_than_half_of_the_blocks_of_documents_are_scored(spark):
    from codestrata.queries.search import document_entities, document_questions
    from codestrata.queries.views import Views

    v = Views(spark, "/root/testdata/sf0.01")
    blocked, tops = pruned.impact_blocks(cut(search.postings(document_entities(v), stem=None)), 32)
    asked = cut(document_questions(v))
    _, visits = pruned.term_top_k_pruned(asked, blocked, tops, stem=None)
    holds = search.search_terms(asked, None).join(tops, ["repository_id", "term"]).select("question_id", "block").distinct()
    scored, possible = visits.count(), holds.count()
    print(scored, possible)
    assert 0 < scored == visits.distinct().count() < possible / 2


def _vectors(spark, rng, n=700):
    """Bundles of like vectors, exact copies, opposite and zero vectors, in one large and one small repository."""
    centres = rng.normal(size=(12, 8))
    rows = [centres[i % 12] + rng.normal(size=8) * 0.15 for i in range(n)]
    rows[3:40] = [rows[2]] * 37
    rows[50], rows[51] = np.zeros(8), -rows[2]
    held = [("hot", i, [float(x) for x in v]) for i, v in enumerate(rows)] + [("small", i, [float(x) for x in rows[i]]) for i in range(5)]
    asked = [("hot", i, v) for _, i, v in held[:n:9]] + [("small", 1, held[0][2]), ("none", 1, held[0][2])]
    return (spark.createDataFrame(asked, "repository_id string, question_id long, embedding array<float>"),
            spark.createDataFrame(held, "repository_id string, id long, embedding array<float>").repartition(5))


@pytest.mark.parametrize("k", [1, 7, 40])
def test_pruned_vectors_are_the_same_rows(spark, k):
    questions, held = _vectors(spark, np.random.default_rng(2))
    rings = pruned.angle_rings(held, 40, 25)
    hits, visits = pruned.vector_top_k_pruned(questions, *rings, k, question_block=10)
    assert _hits(hits) == _hits(search.vector_top_k(questions, held, k))
    sizes = rings[1].select("repository_id", "block", "n")
    multiplied = visits.join(sizes, ["repository_id", "block"]).agg(F.sum("n")).first()[0]
    assert multiplied < 78 * 700 * (0.35 if k < 40 else 0.7)  # of 78 x 700 pairs


def test_one_repository_is_many_tasks(spark):
    questions, held = _vectors(spark, np.random.default_rng(3))
    _, rings, _ = pruned.angle_rings(held, 40, 25)
    largest = rings.where("repository_id = 'hot'").agg(F.count("*"), F.max("n")).first()
    assert largest[0] > 30 and largest[1] < 70


def _named(rng):
    names = ["getUser", "GETUSER", "get", "x", "", "ab", "İstanbul", "aaaa", "réseau", "a_b%c", "get user"]
    names += ["".join(rng.choice("abcAB_") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["common"] * 200
    return [(f"r{i % 3}" if i % 2 else "r0", i, n, rng.choice(["function", "class", "doc", "chunk"]), "f", None) for i, n in enumerate(names)]


def test_needles(spark):
    rng = random.Random(5)
    rows = _named(rng)
    needles = [("r0", i, n) for i, n in enumerate(["get", "GET", " user ", "x", "ab", "", "  ", "aaa", "aaaaa", "é", "%", "_", "b%", "common", "zzz", "absent name", "abc", "t u"])]
    needles += [(f"r{i % 4}", 100 + i, "".join(rng.choice("abcAB_") for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    entities = spark.createDataFrame(rows, "repository_id string, id long, symbol_name string, symbol_type string, file_path string, route string")
    asked = spark.createDataFrame(needles, "repository_id string, needle_id long, needle string")
    for limit in (50, 3):
        want = []
        for repository, number, needle in needles:
            needle = needle.strip().lower()
            hits = sorted((n.lower() != needle, len(n), i) for r, i, n, kind, _, _ in rows if r == repository and needle and kind in ("function", "class") and needle in n.lower())
            want += [(repository, number, rank, i) for rank, (_, _, i) in enumerate(hits[:limit], 1)]
        found = search.find_symbols_of(asked, entities, search.name_grams(entities), limit)
        assert sorted((r.repository_id, r.needle_id, r["rank"], r.id) for r in found.collect()) == sorted(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = search.find_symbols(entities.where("repository_id = 'r0'"), "get")
    assert [r.id for r in one.orderBy("rank").collect()] == [i for _, q, _, i in sorted(w for w in _all(rows, "get")) if q == 0]


def _all(rows, needle):
    hits = sorted((n.lower() != needle, len(n), i) for r, i, n, kind, _, _ in rows if r == "r0" and kind in ("function", "class") and needle in n.lower())
    return [("r0", 0, rank, i) for rank, (_, _, i) in enumerate(hits[:50], 1)]


def test_bounds_are_never_below_a_score(spark):
    """Angles: no entity of a ring is nearer to a question than the ring's bound says."""
    rng = np.random.default_rng(7)
    for _ in range(2000):
        q, p, x = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 4)))
        phi, theta = math.acos(max(-1, min(1, q @ p))), math.acos(max(-1, min(1, x @ p)))
        assert q @ x <= math.cos(max(0.0, phi - theta, theta - phi)) + 1e-9
