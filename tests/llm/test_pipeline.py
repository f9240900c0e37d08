"""Every stage of the pipeline against brute force, on all of its own input."""

import hashlib
import sys
from pathlib import Path

from proselens.llm import decontam as D
from proselens.llm import toxicity

from test_bpe import ORACLE
from test_exact_and_lines import brute_lines
from test_jaccard_join import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    odd = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, "a b c d e f\nx", None, None, None), (90_004, "a b c d e f\nx", "en", "s", 1)]
    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = read.unionByName(spark.createDataFrame(odd, read.schema))
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]

    def step(name):
        nonlocal docs, before
        old, docs = before, P.stored(stages[name](spark, docs, SF))
        if name != "byte-level BPE":
            assert docs.columns == P.COLUMNS
        before = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(before)
        return old, before

    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    old, new = step("toxicity")
    assert set(new) == set(old) - bad and all(new[i] == old[i] for i in new)

    old, new = step("line dedup")
    want = brute_lines([(i, r.text) for i, r in old.items()])
    assert {i: r.text for i, r in new.items()} == {i: "\n".join(x for c in own for x in c) for i, own in want.items()}
    assert all((r.lang, r.source) == (old[i].lang, old[i].source) for i, r in new.items())
    assert all(r.n_chars == (old[i].n_chars if (old[i].text or "") == r.text else len(r.text)) for i, r in new.items())

    old, new = step("n-gram Jaccard join")
    classes = brute([(i, r.text) for i, r in old.items()])
    assert set(new) == {i for i, (c, _) in classes.items() if c == i} and len(new) < len(old)

    old, new = step("benchmark decontamination")
    items = [D.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = set()
    for i, r in old.items():
        text = D.words(r.text)
        if any(len(set(w) & set(text)) >= len(set(w)) - int(0.15 * len(w)) and D.least_distance(w, text)[0] <= int(0.15 * len(w) + 1e-9) for w in items):
            leaked.add(i)
    assert leaked and set(new) == set(old) - leaked and all(new[i] == old[i] for i in new)

    old, new = step("byte-level BPE")
    assert set(new) == set(old)
    for i, r in new.items():
        ids = b"".join(x.to_bytes(4, "little") for x in ORACLE.encode_ordinary(old[i].text))
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(old[i].text.encode()).hexdigest()


def test_rows_of_one_id_or_none_are_told_apart(spark):
    """Only true copies go, whatever the order of rows; nothing is dropped for its doc_id."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "another text of the same id, long enough to have shingles"), (1, " ".join(words)), (None, "x y z a b c d e"),
            (None, "x y z a b c d e"), (None, "p q r s t u v"), (2, " ".join(["other", *words])), (3, "only once here as it seems to be"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs.repartition(parts), SF).collect()]
        want = {(2, rows[6][1]), rows[1], rows[3], rows[5], rows[7], rows[8], rows[9]}
        assert set(got) == want and len(got) == len(want)
