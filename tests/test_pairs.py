"""Sentence-pair cohesion (bitmask blocks) against a plain-Python all-pairs scan."""

import random

from pyspark.sql import functions as F

from proselens.operators import pairs as PR

NOUNS = ["casa", "perro", "gato", "mesa", "libro"]
CONTENT_OTHER = [("VERB", "corre"), ("ADJ", "grande"), ("ADV", "bien")]


def make_tokens(seed=3, n_docs=6):
    """Rows: doc, sent, tok, form, lemma, stem, upos, prontype, number, gender, person."""
    rnd = random.Random(seed)
    rows = []
    for doc in range(n_docs):
        n_sent = rnd.choice([1, 2, 5, 70, 130])  # crosses 64-sentence blocks
        for s in range(n_sent):
            for k in range(rnd.randint(0, 5)):
                r = rnd.random()
                if r < 0.5:
                    form = rnd.choice(NOUNS[: rnd.randint(1, 5)])
                    rows.append((doc, s, k, form, form, form[:3], "NOUN", None, "Sing", "Fem", None))
                elif r < 0.65:
                    rows.append((doc, s, k, "ella", "ella", "ell", "PRON", "Prs", "Sing", "Fem", "3"))
                else:
                    u, form = rnd.choice(CONTENT_OTHER)
                    rows.append((doc, s, k, form, form, form[:3], u, None, None, None, None))
    return rows


def brute(rows):
    from collections import defaultdict
    sents = defaultdict(lambda: defaultdict(lambda: {"noun": set(), "arg": set(), "ns": set(), "cs": set(),
                                                      "nagr": set(), "pagr": set(), "cw": set()}))
    n_sent = defaultdict(int)
    for doc, s, k, form, lemma, stem, upos, prt, num, gen, person in rows:
        n_sent[doc] = max(n_sent[doc], s + 1)
        x = sents[doc][s]
        agr = f"{num or '-'}/{gen or '-'}"
        if upos == "NOUN":
            x["noun"].add(form); x["arg"].add("n|" + lemma); x["ns"].add(stem); x["nagr"].add(agr)
        if upos == "PRON" and prt == "Prs":
            x["arg"].add("p|" + form)
            if person == "3":
                x["pagr"].add(agr)
        if upos in ("NOUN", "PROPN", "VERB", "ADJ", "ADV"):
            x["cw"].add(form); x["cs"].add(stem)
    out = {}
    for doc, S in n_sent.items():
        acc = {k: [0, 0] for k in ("noun", "arg", "stem", "anp")}
        dice_all, dice_adj = [], []
        for j in range(S):
            for i in range(j):
                a, b = sents[doc][i], sents[doc][j]
                hits = {"noun": bool(a["noun"] & b["noun"]), "arg": bool(a["arg"] & b["arg"]),
                        "stem": bool(a["ns"] & b["cs"]) or bool(a["cs"] & b["ns"]), "anp": bool(a["nagr"] & b["pagr"])}
                den = len(a["cw"]) + len(b["cw"])
                dice = 0.0 if den == 0 else 2 * len(a["cw"] & b["cw"]) / den
                dice_all.append(dice)
                if i == j - 1:
                    dice_adj.append(dice)
                for k, v in hits.items():
                    acc[k][0] += v
                    if i == j - 1:
                        acc[k][1] += v
        out[doc] = (acc, sum(dice_all), sum(d * d for d in dice_all), sum(dice_adj), sum(d * d for d in dice_adj))
    return out


def test_pair_stats_equal_brute_force(spark):
    rows = make_tokens()
    schema = ("doc_id long, sent_id int, tok_id int, form string, lemma string, stem string, upos string, "
              "prontype string, number string, gender string, person string")
    tok = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: r for r in PR.pair_stats(tok).collect()}
    exp = brute(rows)
    for doc, (acc, s, q, sa, qa) in exp.items():
        r = got.get(doc)
        for k in ("noun", "arg", "stem", "anp"):
            assert (r[f"{k}_all"] or 0) == acc[k][0] if r else acc[k][0] == 0, (doc, k)
            assert (r[f"{k}_adj"] or 0) == acc[k][1] if r else acc[k][1] == 0, (doc, k)
        if r:
            assert abs((r["cw_s"] or 0) - s) < 1e-9 and abs((r["cw_q"] or 0) - q) < 1e-9
            assert abs((r["cwa_s"] or 0) - sa) < 1e-9 and abs((r["cwa_q"] or 0) - qa) < 1e-9


def test_pair_batches_cut_and_blocked(spark, monkeypatch):
    """Small batches and blocks: documents are completed over batches, blocks hold few counters."""
    monkeypatch.setattr(PR, "BLOCK", 7)
    monkeypatch.setattr(PR, "WORDS", 20)
    rows = make_tokens(seed=11, n_docs=5)
    tok = spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, form string, lemma string, stem string, upos string, "
                                      "prontype string, number string, gender string, person string")
    import pyarrow as pa
    t = pa.Table.from_pandas(PR._words(tok).toPandas().sort_values(["doc_id", "sent_id"]), preserve_index=False)
    exp = {doc: v for doc, v in brute(rows).items() if doc in {r[0] for r in rows}}
    for adjacent in (False, True):
        got = {r["doc_id"]: r for b in PR._pair_batches(adjacent)(iter(t.to_batches(max_chunksize=9))) for r in b.to_pylist()}
        assert set(got) == set(exp)
        for doc, (acc, s, q, sa, qa) in exp.items():
            r = got[doc]
            assert all(r[f"{k}_adj"] == acc[k][1] for k in acc) and abs(r["cwa_s"] - sa) < 1e-9 and abs(r["cwa_q"] - qa) < 1e-9
            if not adjacent:
                assert all(r[f"{k}_all"] == acc[k][0] for k in acc) and abs(r["cw_s"] - s) < 1e-9 and abs(r["cw_q"] - q) < 1e-9


def test_cohesion_plan_has_no_row_per_item(spark):
    """The items are neither exploded nor joined: the words are exchanged once."""
    docs = spark.createDataFrame([(1, "en", "A cat sees a house. The cat runs.")], "doc_id long, lang string, text string")
    from proselens.operators import annotate as A
    plan = PR.pair_stats(A.tokens(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
