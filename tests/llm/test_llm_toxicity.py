import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import langid, toxicity
from cuesheet.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def split(text):
    """Sentences by hand: at marks and line ends, 64 words at most, words of letters, digits and non-ASCII characters."""
    out = []
    for piece in re.split(r"[.!?\n]", text):
        words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", piece)
        out += [words[i : i + 64] for i in range(0, len(words), 64)]
    return [s for s in out if s]


def test_sentences_equal_a_split_by_hand():
    texts = ["One two. Three!\nfour five?", None, "", "...", "ä ö, ü. x" * 3, "word " * 130 + ". end", "no end", "  lead. "]
    got = [[] for _ in texts]
    for b in toxicity.bags(texts):
        for s, t in enumerate(b.text):
            own = (texts[t] or "").encode()[b.start[s] : b.end[s]].decode()
            got[t].append((re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", own), int((b.sentence == s).sum())))
    for text, mine in zip(texts, got, strict=True):
        want = split(text or "")
        assert [m[0] for m in mine] == want
        assert [m[1] for m in mine] == [2 * len(w) - 1 for w in want]  # words and pairs


def test_a_text_counts_alike_alone_and_among_others():
    texts = [f"Some words here {i}. And {i} more!" * 40 for i in range(50)]
    together = next(toxicity.bags(texts))
    for i in (0, 17, 49):
        alone = next(toxicity.bags([texts[i]]))
        own = together.text[together.sentence] == i
        assert sorted(alone.features) == sorted(together.features[own])


def test_slopes_are_the_derivatives_of_noisy_or():
    rng = np.random.default_rng(1)
    text = np.sort(rng.integers(0, 6, 20))
    text[:6] = np.arange(6)
    text.sort()
    sentence, features = np.sort(rng.integers(0, 20, 60)), rng.integers(0, 7, 60)
    label, weight, theta = np.array([1, 0, 1, 0, 1, 0]), rng.random(6) + 0.5, rng.normal(size=8) - 1
    loss, slope = toxicity.slopes(theta, features, sentence, text, label, weight)
    chance = [1 / (1 + math.exp(-(theta[-1] + sum(theta[f] for f, s in zip(features, sentence) if s == i)))) for i in range(20)]
    by_hand = 0.0
    for t in range(6):
        clean = math.prod(1 - chance[i] for i in range(20) if text[i] == t)
        by_hand -= weight[t] * math.log(1 - clean if label[t] else clean)
    assert abs(loss - by_hand) < 1e-9
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-6
        up, down = (toxicity.slopes(theta + x * step, features, sentence, text, label, weight)[0] for x in (1, -1))
        assert abs((up - down) / 2e-6 - slope[i]) < 1e-5


def test_minimise_finds_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    found = toxicity.minimise(lambda x: (x @ a @ x / 2 - x.sum(), a @ x - 1), np.ones(3) * 5)
    assert np.allclose(found, [1, 0.1, 0.01], atol=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"), ~langid.held_out())


def test_held_out_documents_and_their_offending_sentences(spark, model):
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang").where(langid.held_out())
    found = toxicity.flag(docs, model).join(read_table(spark, SF, "labels"), "doc_id")
    rows = found.select("lang", "toxic", "score", "predicted", "offending", "text").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert (p >= 0).all() and (p <= 1).all() and [r.predicted for r in rows] == [int(x >= 0.5) for x in p]
    order = p.argsort()
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (y == 0).sum()) > 0.93
    english = np.array([r.lang == "en" for r in rows])
    assert (p[english & (y == 1)] >= 0.5).mean() > 0.85 and (p[y == 0] >= 0.5).mean() < 0.02
    # only documents were labelled, yet blame falls on the sentences with the insults
    insults = re.compile(r"\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b", re.I)
    named = [s for r in rows if r.lang == "en" and r.toxic for s in r.offending]
    assert len(named) > 50 and np.mean([bool(insults.search(s.sentence)) for s in named]) > 0.9
    for r in rows:
        for s in r.offending:
            assert r.text[s.at : s.at + len(s.sentence)] == s.sentence and s.score >= 0.5


def test_edges(spark, model):
    bad = read_table(spark, SF, "labels").where("toxic = 1").join(read_table(spark, SF, "documents").where("lang = 'en'"), "doc_id").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, bad), (4, bad), (None, bad), (5, "Fine words. " * 200_000 + "You idiot moron scum.")]
    df = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, offending string, score double")
    got = toxicity.flag(df, model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "score", "predicted", "offending"]
    assert [(r.score, r.predicted, r.offending) for r in got[:3]] == [(0.0, 0, [])] * 3
    assert got[3][2:] == got[4][2:] == got[5][2:]
    assert got[6].offending[-1].sentence == "You idiot moron scum" and got[6].offending[-1].at == 12 * 200_000
    assert toxicity.flag(df.limit(0), model).count() == 0
    assert toxicity.flag(df, model, prefix="t_").columns == ["doc_id", "text", "offending", "score", "t_score", "t_predicted", "t_offending"]


def test_nothing_to_learn_and_copies(spark):
    docs = spark.createDataFrame([(i, f"text {i} is fine. bad word" if i < 20 else "same text") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("quality"))
    none = toxicity.fit(docs, labels, F.lit(True))
    assert {r.score for r in toxicity.flag(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.flag(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}
    # a text that is labelled both ways counts once, as toxic; unknown labels count not at all
    mixed = labels.withColumn("toxic", F.when(F.col("doc_id") == 59, 1).when(F.col("doc_id") == 3, None).otherwise(0))
    sample = toxicity.training_sample(docs, mixed, F.lit(True)).collect()
    assert len(sample) == 20 and [r.label for r in sample if r.text == "same text"] == [1]
    few = toxicity.training_sample(docs, labels, F.lit(True), per_label=10).collect()
    assert 0 < len(few) < 21 and all(r.weight == 2.1 for r in few)
