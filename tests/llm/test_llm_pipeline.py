import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import test_llm_decontam
import test_llm_linededup
import test_llm_triejoin
from tokenizers import Tokenizer

from cuesheet.llm import langid
from cuesheet.sources.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").where("n_chars < 1500").orderBy("doc_id").limit(70).collect()]
    item = read_table(spark, SF, "benchmark").orderBy("item_id").first().text
    long = max(rows, key=lambda r: r[4])[1]
    words = max((r[1] for r in rows if r[1] != long), key=len).split()
    lines = "\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    near = long.split(" ")
    near[len(near) // 2] = "changed"
    more = [long, " ".join(near), f"{item[:40]} {rows[5][1]} {item}", f"first here\n{lines}", f"then there\n{lines}\nend", lines, "", None, "12 34", "qq zz"]
    rows += [(5000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(more)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, docs):
    columns, now = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_duplicates", "decontamination", "bpe"]

    def step(name):
        nonlocal now
        before = [tuple(r) for r in now.orderBy("doc_id").collect()]
        out = stages[name](spark, now, SF)
        rows = sorted(tuple(r) for r in out.collect())
        if name != "bpe":
            assert out.columns == columns
            now = spark.createDataFrame(rows, docs.schema)
        return before, rows

    before, rows = step("language")
    model = langid.fit(docs, ~langid.held_out())
    rejected = model.predict([r[1] for r in before])[2]
    assert rows == [r for r, no in zip(before, rejected, strict=True) if not no] and len(rows) >= len(before) - 8

    before, rows = step("line_dedup")
    cut = test_llm_linededup.brute([r[:2] for r in before], 50)
    want = [(r[0], t, *r[2:4], len(t) if t != r[1] else r[4]) for r, t in zip(before, cut, strict=True) if t == r[1] or t.strip()]
    assert rows == want and len(rows) < len(before)

    before, rows = step("near_duplicates")
    lead = {d: c for d, _, c in test_llm_triejoin.brute([r[:2] for r in before])}
    assert rows == [r for r in before if lead[r[0]] == r[0]] and len(rows) < len(before)

    before, rows = step("decontamination")
    bench = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    assert rows == [r for r in before if not any(test_llm_decontam.brute(r[1], b) for b in bench)] and len(rows) < len(before)

    before, rows = step("bpe")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for (doc_id, text, *_), got in zip(before, rows, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == (doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_empty_documents(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_each_stage_bounds_what_its_python_workers_get(spark, docs):
    own = spark.newSession()  # as a caller has it that runs the stages by themselves
    now = own.createDataFrame(docs.limit(20).collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for k, v in {"maxRecordsPerBatch": "10000", "maxBytesPerBatch": "64m"}.items():
            own.conf.set(f"spark.sql.execution.arrow.{k}", v)
        stage(own, now, SF)
        assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4096", name
        assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m", name
