"""Registered queries for sources, projections, joins and group slicing (S1-S10, P1-P8, P12,
J1-J6, A1, A2, W1, W3, W4, F1-F4, F7-F9) with their oracle SQL.

Sources, the group map, the group join and the assembled features take the full matrix (146 metrics
of both families).  The other matrix queries take the light one (family C descriptive, lexical
diversity, readability: 14 metrics from one aggregate over all documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import groups as G
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import annotate as A
from ..operators import matrix as MX
from ..operators import metrics as M
from ..operators import pairs as PR
from ..session import new_path, table_path
from ..sources import corpus as CO
from ..sources import io as IO
from . import jobs
from . import oracle as O

C = F.col
FAMILY = "coh_metrix"
DESCRIPTIVE = G.metrics_of(FAMILY, "DESCRIPTIVE")
PAYLOAD_BATCH = 64
N_BATCHES = 4


def _docs(spark, sf_dir):
    return CO.read_documents(spark, sf_dir)


def _read(spark, sf_dir, name):
    return spark.read.parquet(table_path(sf_dir, name))


def light(spark, sf_dir) -> DataFrame:
    return M.light_matrix(_docs(spark, sf_dir))


def long_grouped(spark, sf_dir) -> DataFrame:
    return MX.join_metric_group(MX.to_long(light(spark, sf_dir), M.LIGHT), MX.group_map(spark, FAMILY))


def q_scan_corpus_split(spark, sf_dir):
    return CO.scan_corpus_split(spark, sf_dir, "train")


def q_project_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def q_project_label(spark, sf_dir):
    return CO.labels(spark, sf_dir).select("doc_id", "label")


def q_head_texts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(10)


def q_matrix_shape(spark, sf_dir):
    n = _read(spark, sf_dir, "documents").select(F.lit(1).alias("r"), F.lit(None).cast("int").alias("d"))
    e = _read(spark, sf_dir, "embeddings").select(F.lit(0).alias("r"), F.size("embedding").alias("d"))
    return n.unionByName(e).agg(F.sum("r").cast("long").alias("n_rows"),
                                F.lit(len(G.group_rows())).cast("long").alias("n_metrics"),
                                F.max("d").cast("long").alias("emb_dim"))


def q_preprocess_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.preprocess_text(C("text")).alias("text"))


def q_tokenize(spark, sf_dir):
    return A.tokens(_docs(spark, sf_dir)).where(C("form").isNotNull()).select(
        "doc_id", "sent_id", "tok_id", "form", "lemma", "stem", "upos")


def q_syllables(spark, sf_dir):
    return A.tokens(_docs(spark, sf_dir)).where(C("form").isNotNull()).select("doc_id", "sent_id", "tok_id", "n_syll")


def closed_class_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lg, f, u) for lg, f, u, _ in L.closed_class_rows()],
                                 "lang string, form string, lex_upos string")


def q_lexicon_join(spark, sf_dir):
    """Tokens joined with the closed-class lexicon (fixed table: broadcast)."""
    tok = A.tokens(_docs(spark, sf_dir)).where(C("form").isNotNull())
    return (tok.join(F.broadcast(closed_class_lexicon(spark)), ["lang", "form"], "left")
            .select("doc_id", "sent_id", "tok_id", "form", "lex_upos"))


ALL_METRICS = [r[2] for r in G.group_rows()]


def full(spark, sf_dir) -> DataFrame:
    return jobs.full_matrix(_docs(spark, sf_dir))


def _sunk(spark, sf_dir) -> str:
    path = new_path(spark, "matrix")
    IO.sink_metric_matrix(full(spark, sf_dir), path)
    return path


def q_scan_metric_matrix(spark, sf_dir):
    """The full matrix read back from CSV with its schema."""
    return IO.scan_metric_matrix(spark, _sunk(spark, sf_dir), ALL_METRICS)


def q_sink_metric_matrix(spark, sf_dir):
    """S3: every line that the CSV files hold, parsed as text: its fields, and all 146 values of its document."""
    lines = spark.read.text(_sunk(spark, sf_dir)).where(~C("value").startswith("doc_id,"))
    schema = ", ".join(["doc_id bigint"] + [f"{m} double" for m in ALL_METRICS])
    return lines.select(F.size(F.split("value", ",")).cast("long").alias("n_fields"), F.from_csv("value", schema).alias("x")) \
        .select("x.doc_id", "n_fields", *[f"x.{m}" for m in ALL_METRICS])


def q_join_metric_group(spark, sf_dir):
    """Every metric value of both families with its group."""
    return full_long(spark, sf_dir).select("doc_id", "family", "group", "metric", "value")


def full_long(spark, sf_dir) -> DataFrame:
    """All 146 metrics of both families for every document, long, with their groups."""
    wide = jobs.full_matrix(_docs(spark, sf_dir))
    groups = MX.group_map(spark)
    return MX.to_long(wide, [r[2] for r in G.group_rows()]).join(
        F.broadcast(groups.select("metric", "family", "group", "pos")), "metric")


def q_collect_group_metrics(spark, sf_dir):
    """A1 over both maps: the metric list of all 17 groups, and the values seen."""
    return MX.collect_group_metrics(full_long(spark, sf_dir), by=["family"])


def _grouped_docs(spark, sf_dir) -> DataFrame:
    """Documents as members of groups: the language as family, the source as group."""
    return _read(spark, sf_dir, "documents").select(C("lang").alias("family"), C("source").alias("group"))


def q_distinct_groups(spark, sf_dir):
    """A2: the distinct (family, group) of all metric values; combined before its exchange."""
    return MX.distinct_groups(full_long(spark, sf_dir), by=["family"])


def q_lower_group(spark, sf_dir):
    """on every document's group, in capitals."""
    return _grouped_docs(spark, sf_dir).select("family", F.upper("group").alias("group")) \
        .groupBy("family", "group", T.lower_group(C("group")).alias("group_lower")).agg(F.count(F.lit(1)).alias("n"))


def q_filter_group(spark, sf_dir):
    """The values of one group's metrics, of both families."""
    docs = _docs(spark, sf_dir)
    tok = A.tokens(docs)
    wide = M.c_lexical_diversity(docs, tok).join(M.m_lexical_diversity(docs, tok), "doc_id")
    long = MX.to_long(wide, [c for c in wide.columns if c != "doc_id"])
    return MX.join_metric_group(long, MX.group_map(spark)).where(C("group") == "LEXICAL DIVERSITY").select("doc_id", "metric", "value")


def q_project_group_columns(spark, sf_dir):
    return MX.project_group_columns(light(spark, sf_dir), DESCRIPTIVE)


def q_assemble_features(spark, sf_dir):
    """All 146 metrics as one array."""
    return MX.assemble_features(full(spark, sf_dir), ALL_METRICS)


def q_run_name(spark, sf_dir):
    """the run of every document's (family, group)."""
    return _grouped_docs(spark, sf_dir).groupBy(T.run_name(C("family"), T.lower_group(C("group"))).alias("run_name")) \
        .agg(F.count(F.lit(1)).alias("n"))


def q_join_features(spark, sf_dir):
    return MX.join_features(_read(spark, sf_dir, "embeddings"), light(spark, sf_dir), M.LIGHT)


def q_join_labels(spark, sf_dir):
    f = MX.assemble_features(light(spark, sf_dir), DESCRIPTIVE)
    return MX.join_labels(f, CO.labels(spark, sf_dir).select("doc_id", "label"))


def q_union_batches(spark, sf_dir):
    """The batches' results, written in one pass, are read one by one and appended."""
    path = new_path(spark, "batches")
    light(spark, sf_dir).withColumn("batch", C("doc_id") % N_BATCHES).write.partitionBy("batch").parquet(path)
    schema = IO.matrix_schema(M.LIGHT)
    return MX.union_batches([spark.read.schema(schema).parquet(f"{path}/batch={b}") for b in range(N_BATCHES)])


def q_row_index(spark, sf_dir):
    return MX.row_index(light(spark, sf_dir).select("doc_id", "DESWC"))


def q_scan_group_map(spark, sf_dir):
    """Both group maps read back from CSV, with the number of documents that have a non-zero value of each metric."""
    maps = [IO.scan_group_map(spark, IO.write_group_map(spark, f)).withColumn("family", F.lit(f)) for f in ("coh_metrix", "multiazter")]
    cov = (MX.to_long(full(spark, sf_dir), ALL_METRICS).groupBy("metric")
           .agg(F.count_if(C("value") != 0).alias("n_nonzero")))
    return MX.union_batches(maps).join(F.broadcast(cov), "metric").select("family", "metric", "group", "n_nonzero")


def _payload(spark, sf_dir):
    raw = M.light_matrix(_docs(spark, sf_dir), raw=True)
    keys = ["DESWC", "RDFHGL", "LDTTRcw"]
    rec = raw.select((C("doc_id") / PAYLOAD_BATCH).cast("long").alias("batch"), C("doc_id").alias("pos"),
                     F.create_map(F.lit("doc_id"), C("doc_id").cast("double"),
                                  *[x for k in keys for x in (F.lit(k), C(k))]).alias("m"))
    return IO.payload_text(rec, "batch", "m"), keys


def q_split_marker(spark, sf_dir):
    p, _ = _payload(spark, sf_dir)
    j = T.split_marker(C("raw"), IO.MARKER)
    # number formats differ between engines: the array's outline and the whole numbers are compared
    return p.select("batch", F.substring(j, 1, 11).alias("head"), F.right(j, F.lit(2)).alias("tail"),
                    F.regexp_count(j, F.lit("doc_id")).alias("n_records"), (F.instr(j, IO.MARKER) == 0).alias("marker_gone"))


def q_json_to_map(spark, sf_dir):
    p, _ = _payload(spark, sf_dir)
    return IO.scan_metric_payload(p).select("batch", "pos", F.map_keys("m").alias("keys"),
                                            C("m")["doc_id"].cast("long").alias("doc_id"), C("m")["DESWC"].alias("DESWC"))


def q_scan_metric_payload(spark, sf_dir):
    """S9 + P6 + P5: payload text -> records -> wide columns -> null rule."""
    p, keys = _payload(spark, sf_dir)
    recs = IO.scan_metric_payload(p)
    wide = MX.map_to_wide(recs, "m", ["doc_id"] + keys, [])
    wide = wide.withColumn("doc_id", C("doc_id").cast("long"))
    return MX.null_to_zero(wide, keys)


def q_map_to_wide(spark, sf_dir):
    """S9 + P6: payload text -> records -> wide columns; the metrics under the null rule, a key that no map has stays null."""
    p, keys = _payload(spark, sf_dir)
    wide = MX.map_to_wide(IO.scan_metric_payload(p), "m", ["doc_id"] + keys + ["none"], [])
    return MX.null_to_zero(wide.withColumn("doc_id", C("doc_id").cast("long")), keys)


def q_null_to_zero(spark, sf_dir):
    """P5: the columns of P6, all under the null rule."""
    return MX.null_to_zero(q_map_to_wide(spark, sf_dir), ["none"])


def q_scan_embeddings(spark, sf_dir):
    """The vectors that were written, read back."""
    path = new_path(spark, "embeddings")
    IO.sink_embeddings(_read(spark, sf_dir, "embeddings"), path)
    e = IO.scan_embeddings(spark, path)
    return e.select("vec_id", C("embedding").cast("array<double>").alias("embedding"), "label")


def q_sink_embeddings(spark, sf_dir):
    """What the files hold: every vector, with the number of its values."""
    path = new_path(spark, "embeddings")
    IO.sink_embeddings(_read(spark, sf_dir, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", C("embedding").cast("array<double>").alias("embedding"), "label",
                                           F.size("embedding").cast("long").alias("n_values"))


def _annotated(spark, sf_dir) -> DataFrame:
    """Tokens rendered as CoNLL-U in the shared folder (HEAD: half the token's number) and read back."""
    path = new_path(spark, "conllu")
    head = F.floor((C("tok_id") + 1) / 2).cast("int")
    IO.tokens_to_conllu(A.tokens(_docs(spark, sf_dir)), head).write.option("compression", "gzip").text(path)
    return IO.scan_annotated_tokens(spark, path)


def q_scan_annotated_tokens(spark, sf_dir):
    """Sentences are numbered in file order, so those without words do not count."""
    return _annotated(spark, sf_dir).select("doc_id", "sent_id", "tok_id", "form", "lemma", "upos", "head")


def q_mean_depth(spark, sf_dir):
    """S10 to metrics: mean of the greatest depth of each sentence's parse."""
    return IO.mean_depth(_annotated(spark, sf_dir))


def q_phrase_islands(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    s = M.sentence_level(A.tokens(docs))
    return (docs.select("doc_id").join(s, "doc_id", "left")
            .select("doc_id", *[F.coalesce(C(c), F.lit(0)).cast("long").alias(a)
                                for c, a in (("NP", "n_np"), ("VP", "n_vp"), ("NP_len", "np_tokens"))]))


ADJ_KEYS = ["CRFNO1", "CRFAO1", "CRFSO1", "CRFCWO1", "CRFANP1"]
ALL_KEYS = ["CRFNOa", "CRFAOa", "CRFSOa", "CRFCWOa", "CRFANPa"]


def q_adjacent_sentence(spark, sf_dir):
    return M.finish(PR.adjacent_cohesion(A.tokens(_docs(spark, sf_dir))), ADJ_KEYS)


def q_sentence_pair_join(spark, sf_dir):
    return PR.c_referential_cohesion(_docs(spark, sf_dir)).select("doc_id", *ALL_KEYS)


QUERIES = {
    "scan_corpus_split": q_scan_corpus_split, "project_text": q_project_text, "project_label": q_project_label,
    "head_texts": q_head_texts, "matrix_shape": q_matrix_shape, "preprocess_text": q_preprocess_text,
    "tokenize": q_tokenize, "syllables": q_syllables, "lexicon_join": q_lexicon_join,
    "sink_metric_matrix": q_sink_metric_matrix, "scan_metric_matrix": q_scan_metric_matrix,
    "join_metric_group": q_join_metric_group, "collect_group_metrics": q_collect_group_metrics,
    "distinct_groups": q_distinct_groups, "filter_group": q_filter_group,
    "project_group_columns": q_project_group_columns, "assemble_features": q_assemble_features,
    "lower_group": q_lower_group, "run_name": q_run_name, "join_features": q_join_features,
    "join_labels": q_join_labels, "union_batches": q_union_batches, "row_index": q_row_index,
    "scan_group_map": q_scan_group_map, "split_marker": q_split_marker, "json_to_map": q_json_to_map,
    "scan_metric_payload": q_scan_metric_payload, "null_to_zero": q_null_to_zero,
    "map_to_wide": q_map_to_wide, "scan_embeddings": q_scan_embeddings,
    "sink_embeddings": q_sink_embeddings, "scan_annotated_tokens": q_scan_annotated_tokens,
    "mean_depth": q_mean_depth,
    "phrase_islands": q_phrase_islands, "adjacent_sentence": q_adjacent_sentence,
    "sentence_pair_join": q_sentence_pair_join,
}

# --------------------------------------------------------------------------- oracle SQL

_LIGHT_COLS = [("DESPC", "P"), ("DESSC", "S"), ("DESWC", "N"), ("DESPL", "pl_mean"), ("DESPLd", "pl_std"),
               ("DESSL", "sl_mean"), ("DESSLd", "sl_std"), ("DESWLsy", "syl_mean"), ("DESWLsyd", "syl_std"),
               ("DESWLlt", "chr_mean"), ("DESWLltd", "chr_std"), ("LDTTRa", O.div("V", "N")),
               ("LDTTRcw", O.div("V_content", "content_n")), ("RDFHGL", O.huerta())]


def _light_ctes() -> str:
    cols = ", ".join(f"coalesce(({e})::DOUBLE, 0.0) AS {n}" for n, e in _LIGHT_COLS)
    raw = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _LIGHT_COLS)
    return O._with(O.token_ctes(), O.DOC_AGG, O.SENT_AGG,
                   f"lw AS (SELECT doc_id, {cols} FROM dc JOIN sagg USING (doc_id) JOIN pagg USING (doc_id))",
                   f"lraw AS (SELECT doc_id, {raw} FROM dc JOIN sagg USING (doc_id) JOIN pagg USING (doc_id))")


def _gm_values() -> str:
    rows = [f"({p}, {O._q(m)}, {O._q(g)})" for f, p, m, g in G.group_rows() if f == FAMILY]
    return f"gm(pos, metric, grp) AS (VALUES {', '.join(rows)})"


_BOTH = "both_maps(family, pos, metric, grp) AS (VALUES " + ", ".join(
    f"({O._q(f)}, {p}, {O._q(m)}, {O._q(g)})" for f, p, m, g in G.group_rows()) + ")"


def _long() -> str:
    unp = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, {m} AS value FROM lw" for m in M.LIGHT)
    return _light_ctes() + f",\n{_gm_values()},\nlg AS (SELECT l.doc_id, gm.grp, l.metric, l.value, gm.pos FROM ({unp}) l JOIN gm USING (metric))"


def _r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def _rl(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v::DOUBLE, 6))"


_KEYS = [O.q_c_descriptive, O.q_c_word_information, O.q_c_pattern_density, O.q_c_syntactic_complexity, O.q_c_connectives,
         O.q_c_lexical_diversity, O.q_c_readability, O.q_m_connectives, O.q_m_descriptive, O.q_m_lexical_diversity, O.q_m_readability,
         O.q_m_syntax, O.q_m_morphology, O.q_c_referential_cohesion, O.q_m_referential_cohesion, O.q_m_word_frequency, O.q_m_semantics]


def _full(keys=_KEYS) -> str:
    """The keys' own oracles, joined."""
    return "(SELECT * FROM " + " JOIN ".join(f"({q()}) k{i}" + (" USING (doc_id)" if i else "") for i, q in enumerate(keys)) + ")"


_DIVERSITY = G.metrics_of("coh_metrix", "LEXICAL DIVERSITY") + G.metrics_of("multiazter", "LEXICAL DIVERSITY")
_ALL_OUT = ", ".join(f"{_r(m)} AS {m}" for m in ALL_METRICS)
_ALL_LONG = f"(UNPIVOT (SELECT doc_id, {', '.join(f'{m}::DOUBLE AS {m}' for m in ALL_METRICS)} FROM {_full()}) ON {', '.join(ALL_METRICS)} INTO NAME metric VALUE value)"

_LIGHT_OUT = ", ".join(f"{_r(m)} AS {m}" for m in M.LIGHT)
_DESC_OUT = ", ".join(f"{_r(m)} AS {m}" for m in DESCRIPTIVE)
_DESC_LIST = "[" + ", ".join(DESCRIPTIVE) + "]"
_TOK = O._with(O.token_ctes())
_PAIR_LIGHT = O._with(O.token_ctes(), O.PAIR_AGG)

_NUMBERED = """,
num AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1)::INT AS s FROM tok WHERE form IS NOT NULL)"""

ORACLE = {
    "scan_corpus_split": "SELECT d.doc_id, d.text, l.quality::INT AS label, 'train' AS split FROM documents d "
                         "JOIN labels l USING (doc_id) WHERE d.doc_id % 5 <> 0",
    "project_text": "SELECT doc_id, text FROM documents",
    "project_label": "SELECT doc_id, quality::INT AS label FROM labels",
    "head_texts": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10",
    "matrix_shape": f"SELECT (SELECT count(*) FROM documents) AS n_rows, {len(G.group_rows())}::BIGINT AS n_metrics, "
                    "(SELECT max(len(embedding)) FROM embeddings)::BIGINT AS emb_dim",
    "preprocess_text": "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS text FROM documents",
    "tokenize": _TOK + "\nSELECT doc_id, sent_id, tok_id, form, lemma, stem, upos FROM tok WHERE form IS NOT NULL",
    "syllables": _TOK + "\nSELECT doc_id, sent_id, tok_id, n_syll::INT AS n_syll FROM tok WHERE form IS NOT NULL",
    "lexicon_join": _TOK + "\nSELECT t.doc_id, t.sent_id, t.tok_id, t.form, lx.upos AS lex_upos FROM tok t "
                           "LEFT JOIN lex lx ON lx.lang = t.lang AND lx.form = t.form WHERE t.form IS NOT NULL",
    "sink_metric_matrix": f"SELECT doc_id, {len(ALL_METRICS) + 1}::BIGINT AS n_fields, {_ALL_OUT} FROM {_full()}",
    "scan_metric_matrix": f"SELECT doc_id, {_ALL_OUT} FROM {_full()}",
    "join_metric_group": f"WITH {_BOTH}\nSELECT doc_id, family, grp AS \"group\", metric, {_r('value')} AS value FROM {_ALL_LONG} JOIN both_maps USING (metric)",
    "collect_group_metrics": f"WITH {_BOTH}, n AS (SELECT count(*) AS n FROM documents)\nSELECT family, grp AS \"group\", "
                             "list(metric ORDER BY pos) AS metrics, (count(*) * (SELECT n FROM n))::BIGINT AS n_values "
                             "FROM both_maps GROUP BY family, grp",
    "distinct_groups": f"WITH {_BOTH}\nSELECT DISTINCT family, grp AS \"group\" FROM {_ALL_LONG} JOIN both_maps USING (metric)",
    "filter_group": "SELECT doc_id, metric, " + _r("value") + " AS value FROM (UNPIVOT (SELECT doc_id, "
                    + ", ".join(f"{m}::DOUBLE AS {m}" for m in _DIVERSITY) + " FROM " + _full([O.q_c_lexical_diversity, O.q_m_lexical_diversity])
                    + ") ON " + ", ".join(_DIVERSITY) + " INTO NAME metric VALUE value)",
    "project_group_columns": _light_ctes() + f"\nSELECT doc_id, {_DESC_OUT} FROM lw",
    "assemble_features": "SELECT doc_id, " + _rl("[" + ", ".join(ALL_METRICS) + "]") + " AS features FROM " + _full(),
    "lower_group": "SELECT lang AS family, upper(source) AS \"group\", lower(source) AS group_lower, count(*) AS n FROM documents GROUP BY ALL",
    "run_name": "SELECT lang || '_' || lower(source) AS run_name, count(*) AS n FROM documents GROUP BY 1",
    "join_features": _light_ctes() + "\nSELECT lw.doc_id, " + _rl(
        "list_concat(list_transform(e.embedding, lambda v: v::DOUBLE), [" + ", ".join(M.LIGHT) + "])")
                     + " AS features FROM embeddings e JOIN lw ON lw.doc_id = e.vec_id",
    "join_labels": _light_ctes() + f"\nSELECT lw.doc_id, {_rl(_DESC_LIST)} AS features, l.quality::INT AS label "
                                   "FROM lw JOIN labels l ON l.doc_id = lw.doc_id",
    "union_batches": _light_ctes() + f"\nSELECT doc_id, {_LIGHT_OUT} FROM lw",
    "row_index": _light_ctes() + "\nSELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS \"index\", doc_id, "
                                 + _r("DESWC") + " AS DESWC FROM lw",
    "scan_group_map": f"WITH {_BOTH}\nSELECT family, metric, grp AS \"group\", count(*) FILTER (WHERE value <> 0) AS n_nonzero "
                      f"FROM {_ALL_LONG} JOIN both_maps USING (metric) GROUP BY ALL",
    "split_marker": "SELECT (doc_id // " + str(PAYLOAD_BATCH) + ")::BIGINT AS batch, '[{\"doc_id\":' AS head, '}]' AS tail, "
                    "count(*)::INT AS n_records, TRUE AS marker_gone FROM documents GROUP BY 1",
    "json_to_map": _light_ctes() + f"\nSELECT (doc_id // {PAYLOAD_BATCH})::BIGINT AS batch, "
                   f"(row_number() OVER (PARTITION BY doc_id // {PAYLOAD_BATCH} ORDER BY doc_id) - 1)::INT AS pos, "
                   "['doc_id', 'DESWC', 'RDFHGL', 'LDTTRcw'] AS keys, doc_id, " + _r("DESWC") + " AS DESWC FROM lraw",
    "scan_metric_payload": _light_ctes() + "\nSELECT doc_id, " + ", ".join(
        f"{_r(f'coalesce({m}, 0.0)')} AS {m}" for m in ("DESWC", "RDFHGL", "LDTTRcw")) + " FROM lraw",
    "scan_embeddings": "SELECT vec_id, " + _rl("embedding") + " AS embedding, label FROM embeddings",
    "sink_embeddings": "SELECT vec_id, " + _rl("embedding") + " AS embedding, label, len(embedding)::BIGINT AS n_values FROM embeddings",
    "scan_annotated_tokens": _TOK + _NUMBERED + "\nSELECT doc_id, s AS sent_id, tok_id, form, lemma, upos, "
                             "((tok_id + 1) // 2)::INT AS head FROM num",
    "mean_depth": "WITH RECURSIVE " + _TOK.lstrip().removeprefix("WITH ") + _NUMBERED + """,
walk(doc_id, s, tok, up, depth) AS (
  SELECT doc_id, s, tok_id, (tok_id + 1) // 2, 1 FROM num
  UNION ALL SELECT doc_id, s, tok, up // 2, depth + 1 FROM walk WHERE up > 0)
SELECT doc_id, """ + _r("avg(m)") + """ AS mean_depth FROM (
  SELECT doc_id, s, max(depth) AS m FROM walk WHERE up = 0 GROUP BY doc_id, s) GROUP BY doc_id""",
    "phrase_islands": O._with(O.token_ctes(), O.DOC_AGG, O.SENT_AGG) + "\nSELECT d.doc_id, coalesce(np.k, 0)::BIGINT AS n_np, "
                      "coalesce(vp.k, 0)::BIGINT AS n_vp, coalesce(np.len, 0)::BIGINT AS np_tokens "
                      "FROM d LEFT JOIN np USING (doc_id) LEFT JOIN vp USING (doc_id)",
    "adjacent_sentence": _PAIR_LIGHT + "\n" + O.out([(c, c) for c in ADJ_KEYS], "pa"),
    "sentence_pair_join": _PAIR_LIGHT + "\n" + O.out([(c, c) for c in ALL_KEYS], "pa"),
}
_PAYLOAD_WIDE = ORACLE["scan_metric_payload"].removesuffix(" FROM lraw")
ORACLE["map_to_wide"] = _PAYLOAD_WIDE + ", NULL::DOUBLE AS none FROM lraw"
ORACLE["null_to_zero"] = _PAYLOAD_WIDE + ", 0.0::DOUBLE AS none FROM lraw"
