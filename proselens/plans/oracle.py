"""DuckDB oracle SQL for the correctness gate.

Written as an independent formulation of the same definitions: structure by
``unnest`` + window ``row_number``, tags by a ``LEFT JOIN`` on a ``VALUES``
lexicon plus regex ``CASE``, moments by ``avg``/``stddev_pop``, phrase runs by
gaps-and-islands, connectives by list-slice equality joins, MTLD by
``list_reduce``, sentence pairs by brute force over all pairs.  Only the fixed
word tables are shared (rendered from ``functions.lexicon``).
"""

from __future__ import annotations

from ..functions import lexicon as L

FEATS = ("Person", "Number", "Gender", "PronType", "Tense", "Mood", "VerbForm", "Irregular", "Polarity")


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def lexicon_values() -> str:
    rows = []
    for lang, form, upos, f in L.closed_class_rows():
        rows.append("(" + ", ".join([_q(lang), _q(form), _q(upos)] + [_q(f.get(k)) for k in FEATS]) + ")")
    cols = "lang, form, upos, " + ", ".join(k.lower() for k in FEATS)
    return f"lex({cols}) AS (VALUES {', '.join(rows)})"


def connective_values() -> str:
    rows = [f"({_q(lg)}, {_q(p)}, {n}, {_q(c)})" for lg, p, n, c in L.connective_rows()]
    return f"conn(lang, phrase, n_words, cls) AS (VALUES {', '.join(rows)})"


def _suffix_case() -> str:
    parts = ["CASE WHEN x.word IS NULL THEN NULL WHEN lx.form IS NOT NULL THEN 0",
             "WHEN x.cap AND x.tok_id > 0 THEN 90"]
    for i, (pat, _, _) in enumerate(L.SUFFIX_RULES, start=1):
        parts.append(f"WHEN regexp_matches(x.form, {_q(pat)}) THEN {i}")
    parts.append(f"WHEN length(x.form) >= {L.NOUN_MIN_LETTERS} THEN 98 ELSE 99 END")
    return " ".join(parts)


def _open_feat(name: str) -> str:
    whens = [f"WHEN rule = {i} THEN {_q(v)}" for i, (_, _, fs) in enumerate(L.SUFFIX_RULES, start=1)
             if (v := L._parse_feats(fs).get(name))]
    return f"CASE {' '.join(whens)} END" if whens else "NULL"


def token_ctes() -> str:
    """CTEs ``d, para, sent, tok`` (plus lexicon tables) over the ``documents`` view."""
    upos_case = " ".join(f"WHEN rule = {i} THEN {_q(u)}" for i, (_, u, _) in enumerate(L.SUFFIX_RULES, start=1))
    fem = " ".join(f"WHEN lang = {_q(lg)} AND regexp_matches(form, {_q(p)}) THEN 'Fem'" for lg, p in L.FEM_SUFFIX.items())
    masc = " ".join(f"WHEN lang = {_q(lg)} AND regexp_matches(form, {_q(p)}) THEN 'Masc'" for lg, p in L.MASC_SUFFIX.items())
    return f"""
{lexicon_values()},
{connective_values()},
d AS (SELECT doc_id, lang, text FROM documents),
p0 AS (SELECT doc_id, lang, unnest(string_split_regex(text, E'\\n+')) AS p,
              generate_subscripts(string_split_regex(text, E'\\n+'), 1) AS pi FROM d),
para AS (SELECT doc_id, lang, p, (row_number() OVER (PARTITION BY doc_id ORDER BY pi) - 1)::INT AS para_id
         FROM p0 WHERE regexp_matches(p, '\\p{{L}}')),
s0 AS (SELECT doc_id, lang, para_id, unnest(string_split_regex(p, '{L.SENT_SPLIT}')) AS raw,
              generate_subscripts(string_split_regex(p, '{L.SENT_SPLIT}'), 1) AS si FROM para),
sent AS (SELECT doc_id, lang, para_id, raw,
                (row_number() OVER (PARTITION BY doc_id, para_id ORDER BY si) - 1)::INT AS sent_in_para,
                (row_number() OVER (PARTITION BY doc_id ORDER BY para_id, si) - 1)::INT AS sent_id
         FROM s0 WHERE regexp_matches(raw, '\\p{{L}}')),
w0 AS (SELECT doc_id, lang, para_id, sent_id, unnest(regexp_extract_all(raw, '\\p{{L}}+')) AS word,
              (generate_subscripts(regexp_extract_all(raw, '\\p{{L}}+'), 1) - 1)::INT AS tok_id FROM sent),
w1 AS (SELECT *, lower(word) AS form, left(word, 1) <> lower(left(word, 1)) AS cap FROM w0),
t0 AS (SELECT x.*, {_suffix_case()} AS rule, lx.upos AS lx_upos, lx.person AS lx_person,
              lx.number AS lx_number, lx.gender AS lx_gender, lx.prontype AS lx_prontype,
              lx.tense AS lx_tense, lx.mood AS lx_mood, lx.verbform AS lx_verbform,
              lx.irregular AS lx_irregular, lx.polarity AS lx_polarity
       FROM w1 x LEFT JOIN lex lx ON lx.lang = x.lang AND lx.form = x.form),
t1 AS (SELECT *, CASE WHEN rule = 0 THEN lx_upos WHEN rule = 90 THEN 'PROPN' {upos_case}
                      WHEN rule = 98 THEN 'NOUN' ELSE 'X' END AS upos,
              regexp_matches(form, '{L.PLURAL_SUFFIX}') AS plural FROM t0),
tok AS (SELECT doc_id, lang, para_id, sent_id, tok_id, form,
               CASE WHEN upos IN ('NOUN', 'ADJ') AND plural AND length(form) > 3
                    THEN left(form, length(form) - 1) ELSE form END AS lemma,
               CASE WHEN length(regexp_replace(form, '{L.STEM_SUFFIX}', '')) >= {L.STEM_MIN_LETTERS}
                    THEN regexp_replace(form, '{L.STEM_SUFFIX}', '') ELSE form END AS stem,
               upos, cap,
               CASE WHEN rule = 0 THEN lx_person END AS person,
               CASE WHEN rule = 0 THEN lx_number WHEN upos IN ('NOUN', 'PROPN', 'ADJ') AND plural THEN 'Plur'
                    WHEN upos IN ('NOUN', 'PROPN', 'ADJ') THEN 'Sing' END AS number,
               CASE WHEN rule = 0 THEN lx_gender
                    WHEN upos IN ('NOUN', 'PROPN', 'ADJ') THEN (CASE {fem} {masc} END) END AS gender,
               CASE WHEN rule = 0 THEN lx_prontype END AS prontype,
               CASE WHEN rule = 0 THEN lx_tense ELSE {_open_feat("Tense")} END AS tense,
               CASE WHEN rule = 0 THEN lx_mood ELSE {_open_feat("Mood")} END AS mood,
               CASE WHEN rule = 0 THEN lx_verbform ELSE {_open_feat("VerbForm")} END AS verbform,
               coalesce(rule = 0 AND lx_irregular = 'Yes', false) AS irregular,
               coalesce(rule = 0 AND lx_polarity = 'Neg', false) AS neg,
               rule = 0 AS stop,
               greatest(1, CASE WHEN lang = 'es' THEN len(regexp_extract_all(form, '{L.SYLLABLE_ES}'))
                                ELSE len(regexp_extract_all(form, '{L.SYLLABLE_OTHER}')) END) AS n_syll,
               length(form) AS n_char,
               upos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV') AS content,
               upos = 'PRON' AND prontype IS NOT DISTINCT FROM 'Prs' AS prs0
        FROM (SELECT *, CASE WHEN rule = 0 THEN lx_prontype END AS prontype FROM t1))"""


def inc(x: str, n: str = "N") -> str:
    return f"CASE WHEN {n} = 0 THEN NULL ELSE ({x})::DOUBLE * 1000.0::DOUBLE / ({n})::DOUBLE END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN NULL ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def out(cols: list[str], body: str) -> str:
    sel = ", ".join(f"round(coalesce(({expr})::DOUBLE, 0.0), 6) AS {name}" for name, expr in cols)
    return f"SELECT doc_id, {sel} FROM {body}"


DOC_AGG = """
dc AS (SELECT d.doc_id, any_value(d.lang) AS lang, count(t.form) AS N,
              count(DISTINCT t.sent_id) AS S, count(DISTINCT t.para_id) AS P,
              sum(t.n_syll) AS syl_s, sum(t.n_char) AS chr_s,
              count(*) FILTER (WHERE t.upos = 'NOUN') AS noun, count(*) FILTER (WHERE t.upos = 'PROPN') AS propn,
              count(*) FILTER (WHERE t.upos = 'VERB') AS verb, count(*) FILTER (WHERE t.upos = 'ADJ') AS adj,
              count(*) FILTER (WHERE t.upos = 'ADV') AS adv, count(*) FILTER (WHERE t.upos = 'SCONJ') AS sconj,
              count(*) FILTER (WHERE t.content) AS content_n, count(*) FILTER (WHERE t.prs0) AS prs_n,
              count(*) FILTER (WHERE t.neg) AS neg_n,
              count(*) FILTER (WHERE t.verbform = 'Ger') AS ger, count(*) FILTER (WHERE t.verbform = 'Inf') AS inf,
              count(*) FILTER (WHERE t.mood = 'Imp') AS imp, count(*) FILTER (WHERE t.mood = 'Ind') AS ind,
              count(*) FILTER (WHERE t.tense = 'Past') AS past, count(*) FILTER (WHERE t.tense = 'Pres') AS pres,
              count(*) FILTER (WHERE t.tense = 'Past' AND t.irregular) AS past_irr,
              count(*) FILTER (WHERE t.prs0 AND t.person = '1') AS prs1,
              count(*) FILTER (WHERE t.prs0 AND t.person = '1' AND t.number = 'Sing') AS prs1s,
              count(*) FILTER (WHERE t.prs0 AND t.person = '1' AND t.number = 'Plur') AS prs1p,
              count(*) FILTER (WHERE t.prs0 AND t.person = '2' AND t.number = 'Sing') AS prs2s,
              count(*) FILTER (WHERE t.prs0 AND t.person = '2' AND t.number = 'Plur') AS prs2p,
              count(*) FILTER (WHERE t.prs0 AND t.person = '3') AS prs3,
              count(*) FILTER (WHERE t.prs0 AND t.person = '3' AND t.number = 'Sing') AS prs3s,
              count(*) FILTER (WHERE t.prs0 AND t.person = '3' AND t.number = 'Plur') AS prs3p,
              count(DISTINCT t.form) AS V,
              count(DISTINCT t.form) FILTER (WHERE t.content) AS V_content,
              count(DISTINCT t.form) FILTER (WHERE t.upos = 'ADJ') AS V_adj,
              count(DISTINCT t.form) FILTER (WHERE t.upos = 'ADV') AS V_adv,
              count(DISTINCT t.form) FILTER (WHERE t.upos = 'NOUN') AS V_noun,
              count(DISTINCT t.form) FILTER (WHERE t.upos = 'VERB') AS V_verb,
              count(DISTINCT t.lemma) AS VL,
              count(DISTINCT t.lemma) FILTER (WHERE t.content) AS VL_content,
              count(DISTINCT t.lemma) FILTER (WHERE t.upos = 'ADJ') AS VL_adj,
              count(DISTINCT t.lemma) FILTER (WHERE t.upos = 'ADV') AS VL_adv,
              count(DISTINCT t.lemma) FILTER (WHERE t.upos = 'NOUN') AS VL_noun,
              count(DISTINCT t.lemma) FILTER (WHERE t.upos = 'VERB') AS VL_verb,
              avg(t.n_syll) AS syl_mean, stddev_pop(t.n_syll) AS syl_std,
              avg(t.n_char) AS chr_mean, stddev_pop(t.n_char) AS chr_std,
              avg(length(t.lemma)) AS lem_mean, stddev_pop(length(t.lemma)) AS lem_std,
              avg(t.n_char) FILTER (WHERE NOT t.stop) AS ns_chr_mean,
              stddev_pop(t.n_char) FILTER (WHERE NOT t.stop) AS ns_chr_std
       FROM d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY d.doc_id)"""

SENT_AGG = """
slen AS (SELECT s.doc_id, s.sent_id, count(t.form) AS n, count(t.form) FILTER (WHERE NOT t.stop) AS m,
                coalesce(min(t.tok_id) FILTER (WHERE t.upos = 'VERB'), min(t.tok_id) FILTER (WHERE t.upos = 'AUX')) AS mv
         FROM sent s LEFT JOIN tok t ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id GROUP BY s.doc_id, s.sent_id),
sagg AS (SELECT d.doc_id, avg(n) AS sl_mean, stddev_pop(n) AS sl_std, avg(m) AS m_mean, stddev_pop(m) AS m_std,
                avg(mv) AS mv_mean
         FROM d LEFT JOIN slen USING (doc_id) GROUP BY d.doc_id),
plen AS (SELECT doc_id, para_id, count(*) AS c FROM sent GROUP BY doc_id, para_id),
pagg AS (SELECT d.doc_id, avg(c) AS pl_mean, stddev_pop(c) AS pl_std FROM d LEFT JOIN plen USING (doc_id) GROUP BY d.doc_id),
tc AS (SELECT *, CASE WHEN upos IN ('NOUN', 'PROPN', 'ADJ', 'DET', 'NUM') THEN 1 ELSE 0 END AS in_np,
              CASE WHEN upos IN ('VERB', 'AUX') THEN 1 ELSE 0 END AS in_vp FROM tok WHERE form IS NOT NULL),
np_i AS (SELECT doc_id, sent_id, tok_id - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS isl,
                upos FROM tc WHERE in_np = 1),
np AS (SELECT doc_id, count(*) AS k, sum(len) AS len, sum(adj) AS adj FROM (
         SELECT doc_id, sent_id, isl, count(*) AS len, count(*) FILTER (WHERE upos = 'ADJ') AS adj,
                count(*) FILTER (WHERE upos IN ('NOUN', 'PROPN')) AS nn
         FROM np_i GROUP BY doc_id, sent_id, isl) WHERE nn > 0 GROUP BY doc_id),
vp_i AS (SELECT doc_id, sent_id, tok_id - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS isl,
                upos FROM tc WHERE in_vp = 1),
vp AS (SELECT doc_id, count(*) AS k FROM (
         SELECT doc_id, sent_id, isl FROM vp_i GROUP BY doc_id, sent_id, isl
         HAVING count(*) FILTER (WHERE upos = 'VERB') > 0) GROUP BY doc_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)


def huerta(syl="syl_s", n="N", s="S") -> str:
    return f"206.84::DOUBLE - 60.0::DOUBLE * {div(syl, n)} - 1.02::DOUBLE * {div(n, s)}"


def flesch_en(syl="syl_s", n="N", s="S") -> str:
    return f"206.835::DOUBLE - 84.6::DOUBLE * {div(syl, n)} - 1.015::DOUBLE * {div(n, s)}"


def q_c_descriptive() -> str:
    cols = [("DESPC", "P"), ("DESSC", "S"), ("DESWC", "N"), ("DESPL", "pl_mean"), ("DESPLd", "pl_std"),
            ("DESSL", "sl_mean"), ("DESSLd", "sl_std"), ("DESWLsy", "syl_mean"), ("DESWLsyd", "syl_std"),
            ("DESWLlt", "chr_mean"), ("DESWLltd", "chr_std")]
    return _with(token_ctes(), DOC_AGG, SENT_AGG) + "\n" + out(cols, "dc JOIN sagg USING (doc_id) JOIN pagg USING (doc_id)")


def q_c_word_information() -> str:
    cols = [("WRDNOUN", inc("noun + propn")), ("WRDVERB", inc("verb")), ("WRDADJ", inc("adj")),
            ("WRDADV", inc("adv")), ("WRDPRO", inc("prs_n"))]
    cols += [(f"WRDPRP{p}{n}", inc(f"prs{p}{n}")) for p in "123" for n in "sp"]
    return _with(token_ctes(), DOC_AGG) + "\n" + out(cols, "dc")


def q_c_pattern_density() -> str:
    cols = [("DRNP", inc("coalesce(np.k, 0)")), ("DRVP", inc("coalesce(vp.k, 0)")), ("DRNEG", inc("neg_n"))]
    return (_with(token_ctes(), DOC_AGG, SENT_AGG) + "\n"
            + out(cols, "dc LEFT JOIN np USING (doc_id) LEFT JOIN vp USING (doc_id)"))


def q_c_syntactic_complexity() -> str:
    cols = [("SYNNP", div("np.adj", "np.k")), ("SYNLE", "mv_mean")]
    return (_with(token_ctes(), DOC_AGG, SENT_AGG) + "\n"
            + out(cols, "dc LEFT JOIN np USING (doc_id) JOIN sagg USING (doc_id)"))


CONN_AGG = """
sw AS (SELECT doc_id, lang, sent_id, list(form ORDER BY tok_id) AS w FROM tok WHERE form IS NOT NULL
       GROUP BY doc_id, lang, sent_id),
pos AS (SELECT doc_id, lang, sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM sw),
hits AS (SELECT p.doc_id, p.sent_id, p.i, c.phrase, c.cls FROM pos p JOIN conn c
         ON c.lang = p.lang AND p.w[p.i : p.i + c.n_words - 1] = string_split(c.phrase, ' ')),
cagg AS (SELECT d.doc_id,
                count(DISTINCT h.sent_id::VARCHAR || ':' || h.i::VARCHAR || ':' || h.phrase) AS conn_all,
                count(h.cls) FILTER (WHERE h.cls = 'causal') AS conn_causal,
                count(h.cls) FILTER (WHERE h.cls = 'logical') AS conn_logical,
                count(h.cls) FILTER (WHERE h.cls = 'adversative') AS conn_adversative,
                count(h.cls) FILTER (WHERE h.cls = 'temporal') AS conn_temporal,
                count(h.cls) FILTER (WHERE h.cls = 'additive') AS conn_additive,
                count(h.cls) FILTER (WHERE h.cls = 'conditional') AS conn_conditional
         FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id)"""


def q_c_connectives() -> str:
    cols = [("CNCAll", inc("conn_all")), ("CNCCaus", inc("conn_causal")), ("CNCLogic", inc("conn_logical")),
            ("CNCADC", inc("conn_adversative")), ("CNCTemp", inc("conn_temporal")), ("CNCAdd", inc("conn_additive"))]
    return _with(token_ctes(), DOC_AGG, CONN_AGG) + "\n" + out(cols, "dc JOIN cagg USING (doc_id)")


def q_m_connectives() -> str:
    names = ["adversative", "all", "causal", "conditional", "logical", "temporal"]
    cols = [(f"{n}_connectives_incidence", inc(f"conn_{n}")) for n in names]
    return _with(token_ctes(), DOC_AGG, CONN_AGG) + "\n" + out(cols, "dc JOIN cagg USING (doc_id)")


def q_c_lexical_diversity() -> str:
    cols = [("LDTTRa", div("V", "N")), ("LDTTRcw", div("V_content", "content_n"))]
    return _with(token_ctes(), DOC_AGG) + "\n" + out(cols, "dc")


def q_c_readability() -> str:
    return _with(token_ctes(), DOC_AGG) + "\n" + out([("RDFHGL", huerta())], "dc")


def q_m_readability() -> str:
    expr = f"CASE WHEN lang = 'es' THEN {huerta()} ELSE {flesch_en()} END"
    return _with(token_ctes(), DOC_AGG) + "\n" + out([("flesch", expr)], "dc")


def q_m_descriptive() -> str:
    cols = [("lemmas_length_mean", "lem_mean"), ("lemmas_length_std", "lem_std"),
            ("num_paragraphs_incidence", inc("P")), ("num_sentences_incidence", inc("S")),
            ("num_syllables_words_mean", "syl_mean"), ("num_syllables_words_std", "syl_std"),
            ("sentences_length_mean", "sl_mean"), ("sentences_length_no_stopwords_mean", "m_mean"),
            ("sentences_length_no_stopwords_std", "m_std"), ("sentences_length_std", "sl_std"),
            ("sentences_per_paragraph_mean", "pl_mean"), ("sentences_per_paragraph_std", "pl_std"),
            ("words_length_mean", "chr_mean"), ("words_length_no_stopwords_mean", "ns_chr_mean"),
            ("words_length_no_stopwords_std", "ns_chr_std"), ("words_length_std", "chr_std")]
    return (_with(token_ctes(), DOC_AGG, SENT_AGG) + "\n"
            + out(cols, "dc JOIN sagg USING (doc_id) JOIN pagg USING (doc_id)"))


def _mtld_sql(words: str) -> str:
    t = L.MTLD_THRESHOLD
    one_minus = repr(1.0 - t)

    def fold(lst: str) -> str:
        types = "(CASE WHEN list_contains(acc.types, w) THEN acc.types ELSE list_append(acc.types, w) END)"
        closes = f"(len({types})::DOUBLE / (acc.n + 1)::DOUBLE < {t}::DOUBLE)"
        lam = (f"lambda acc, w: CASE WHEN {closes} THEN {{'f': acc.f + 1.0::DOUBLE, 'types': []::VARCHAR[], 'n': 0}} "
               f"ELSE {{'f': acc.f, 'types': {types}, 'n': acc.n + 1}} END")
        st = f"list_reduce({lst}, {lam}, {{'f': 0.0::DOUBLE, 'types': []::VARCHAR[], 'n': 0}})"
        return (f"list_transform([{st}], lambda r: r.f + CASE WHEN r.n > 0 THEN "
                f"(1.0::DOUBLE - len(r.types)::DOUBLE / r.n::DOUBLE) / {one_minus}::DOUBLE ELSE 0.0::DOUBLE END)[1]")

    n = f"len({words})"
    fw, bw = fold(words), fold(f"list_reverse({words})")
    return (f"CASE WHEN {n} = 0 THEN NULL ELSE "
            f"((CASE WHEN {fw} > 0 THEN {n}::DOUBLE / {fw} END) + (CASE WHEN {bw} > 0 THEN {n}::DOUBLE / {bw} END)) / 2.0::DOUBLE END")


def q_m_lexical_diversity() -> str:
    extra = """
fl AS (SELECT doc_id, count(*) FILTER (WHERE n = 1) AS V1 FROM (SELECT doc_id, form, count(*) AS n FROM tok
       WHERE form IS NOT NULL GROUP BY doc_id, form) GROUP BY doc_id),
dw AS (SELECT d.doc_id, coalesce(list(t.form ORDER BY t.sent_id, t.tok_id) FILTER (WHERE t.form IS NOT NULL), []::VARCHAR[]) AS words
       FROM d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY d.doc_id),
mt AS (SELECT doc_id, MTLD AS mtld FROM dw)""".replace("MTLD", _mtld_sql("words"))
    honore = ("CASE WHEN V > 0 AND coalesce(V1, 0) < V THEN 100.0::DOUBLE * ln(N::DOUBLE) / "
              "(1.0::DOUBLE - coalesce(V1, 0)::DOUBLE / V::DOUBLE) END")
    maas = "CASE WHEN N > 1 AND V > 0 THEN (ln(N::DOUBLE) - ln(V::DOUBLE)) / (ln(N::DOUBLE) * ln(N::DOUBLE)) END"
    cols = [("adj_density", div("adj", "N")), ("adj_ttr", div("V_adj", "adj")), ("adv_density", div("adv", "N")),
            ("adv_ttr", div("V_adv", "adv")), ("content_ttr", div("V_content", "content_n")), ("honore", honore),
            ("lemma_adj_ttr", div("VL_adj", "adj")), ("lemma_adv_ttr", div("VL_adv", "adv")),
            ("lemma_content_ttr", div("VL_content", "content_n")), ("lemma_nttr", div("VL_noun", "noun")),
            ("lemma_ttr", div("VL", "N")), ("lemma_vttr", div("VL_verb", "verb")),
            ("lexical_density", div("content_n", "N")), ("maas", maas), ("mtld", "mtld"),
            ("negation_incidence", inc("neg_n")), ("noun_density", div("noun", "N")), ("nttr", div("V_noun", "noun")),
            ("simple_ttr", div("V", "N")), ("verb_density", div("verb", "N")), ("vttr", div("V_verb", "verb"))]
    return (_with(token_ctes(), DOC_AGG, extra) + "\n"
            + out(cols, "dc LEFT JOIN fl USING (doc_id) JOIN mt USING (doc_id)"))


def q_m_syntax() -> str:
    extra = """
pc AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{P}')) AS punct FROM d)"""
    cols = [("gerund_incidence", inc("ger")), ("infinitive_incidence", inc("inf")),
            ("left_embeddedness", "mv_mean"), ("mean_depth_per_sentence", "NULL"),
            ("mean_np_per_sentence", div("coalesce(np.k, 0)", "S")),
            ("mean_propositions_per_sentence", div("verb", "S")),
            ("mean_vp_per_sentence", div("coalesce(vp.k, 0)", "S")),
            ("noun_phrase_density_incidence", inc("coalesce(np.k, 0)")),
            ("num_decendents_noun_phrase", div("np.len - np.k", "np.k")),
            ("num_modifiers_noun_phrase", div("np.adj", "np.k")),
            ("num_punct_marks_per_sentence", div("punct", "S")),
            ("num_subord_incidence", inc("sconj")),
            ("verb_phrase_density_incidence", inc("coalesce(vp.k, 0)"))]
    return (_with(token_ctes(), DOC_AGG, SENT_AGG, extra) + "\n"
            + out(cols, "dc JOIN sagg USING (doc_id) JOIN pc USING (doc_id) LEFT JOIN np USING (doc_id) "
                        "LEFT JOIN vp USING (doc_id)"))


def q_m_morphology() -> str:
    cols = [("num_adj_incidence", inc("adj")), ("num_adv_incidence", inc("adv")),
            ("num_first_pers_pron_incidence", inc("prs1")), ("num_first_pers_sing_pron_incidence", inc("prs1s")),
            ("num_impera_incidence", inc("imp")), ("num_indic_incidence", inc("ind")),
            ("num_noun_incidence", inc("noun")), ("num_past_incidence", inc("past")),
            ("num_past_irregular_incidence", inc("past_irr")), ("num_past_irregular_mean", div("past_irr", "past")),
            ("num_personal_pronouns_incidence", inc("prs_n")), ("num_pres_incidence", inc("pres")),
            ("num_proper_noun_incidence", inc("propn")), ("num_third_pers_pron_incidence", inc("prs3")),
            ("num_verb_incidence", inc("verb")), ("ratio_proper_nouns_per_nouns", div("propn", "noun + propn"))]
    return _with(token_ctes(), DOC_AGG) + "\n" + out(cols, "dc")


PAIR_AGG = """
si0 AS (SELECT s.doc_id, s.sent_id, t.form, t.lemma, t.stem, t.upos, t.content, t.prs0, t.person,
               coalesce(t.number, '-') || '/' || coalesce(t.gender, '-') AS agr,
               t.upos IN ('NOUN', 'PROPN') AS noun
        FROM sent s LEFT JOIN tok t ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id),
si AS (SELECT doc_id, sent_id,
              coalesce(list(DISTINCT form) FILTER (WHERE noun), []) AS nouns,
              coalesce(list(DISTINCT CASE WHEN noun THEN 'n|' || lemma ELSE 'p|' || form END)
                       FILTER (WHERE noun OR prs0), []) AS args,
              coalesce(list(DISTINCT stem) FILTER (WHERE noun), []) AS nstems,
              coalesce(list(DISTINCT stem) FILTER (WHERE content), []) AS cstems,
              coalesce(list(DISTINCT agr) FILTER (WHERE noun), []) AS nagr,
              coalesce(list(DISTINCT agr) FILTER (WHERE prs0 AND person = '3'), []) AS pagr,
              coalesce(list(DISTINCT form) FILTER (WHERE content), []) AS cw
       FROM si0 GROUP BY doc_id, sent_id),
pr AS (SELECT a.doc_id, b.sent_id - a.sent_id = 1 AS adj,
              list_has_any(a.nouns, b.nouns)::INT AS no_, list_has_any(a.args, b.args)::INT AS ao,
              (list_has_any(a.nstems, b.cstems) OR list_has_any(a.cstems, b.nstems))::INT AS so,
              list_has_any(a.nagr, b.pagr)::INT AS anp,
              CASE WHEN len(a.cw) + len(b.cw) = 0 THEN 0.0::DOUBLE
                   ELSE 2.0::DOUBLE * len(list_intersect(a.cw, b.cw))::DOUBLE / (len(a.cw) + len(b.cw))::DOUBLE END AS dice
       FROM si a JOIN si b ON a.doc_id = b.doc_id AND a.sent_id < b.sent_id),
pa AS (SELECT d.doc_id,
              avg(no_) FILTER (WHERE adj) AS CRFNO1, avg(ao) FILTER (WHERE adj) AS CRFAO1,
              avg(so) FILTER (WHERE adj) AS CRFSO1, avg(dice) FILTER (WHERE adj) AS CRFCWO1,
              stddev_pop(dice) FILTER (WHERE adj) AS CRFCWO1d, avg(anp) FILTER (WHERE adj) AS CRFANP1,
              avg(no_) AS CRFNOa, avg(ao) AS CRFAOa, avg(so) AS CRFSOa, avg(dice) AS CRFCWOa,
              stddev_pop(dice) AS CRFCWOad, avg(anp) AS CRFANPa
       FROM d LEFT JOIN pr ON pr.doc_id = d.doc_id GROUP BY d.doc_id)"""

C_COHESION = ["CRFNO1", "CRFAO1", "CRFSO1", "CRFCWO1", "CRFCWO1d", "CRFANP1",
              "CRFNOa", "CRFAOa", "CRFSOa", "CRFCWOa", "CRFCWOad", "CRFANPa"]
M_COHESION = {
    "argument_overlap_adjacent": "CRFAO1", "argument_overlap_all": "CRFAOa",
    "content_overlap_adjacent_mean": "CRFCWO1", "content_overlap_adjacent_std": "CRFCWO1d",
    "content_overlap_all_mean": "CRFCWOa", "content_overlap_all_std": "CRFCWOad",
    "noun_overlap_adjacent": "CRFNO1", "noun_overlap_all": "CRFNOa",
    "stem_overlap_adjacent": "CRFSO1", "stem_overlap_all": "CRFSOa",
}


def q_c_referential_cohesion() -> str:
    return _with(token_ctes(), PAIR_AGG) + "\n" + out([(c, c) for c in C_COHESION], "pa")


def q_m_referential_cohesion() -> str:
    return _with(token_ctes(), PAIR_AGG) + "\n" + out(list(M_COHESION.items()), "pa")


def q_m_word_frequency() -> str:
    extra = f"""
voc AS (SELECT lang, form, count(*) AS n FROM tok WHERE form IS NOT NULL GROUP BY lang, form),
tot AS (SELECT lang, sum(n) AS total FROM voc GROUP BY lang),
vz AS (SELECT v.lang, v.form, log10(1e9::DOUBLE * v.n::DOUBLE / t.total::DOUBLE) AS zipf
       FROM voc v JOIN tot t USING (lang)),
tz AS (SELECT t.*, vz.zipf, t.content AND vz.zipf < {L.RARE_ZIPF}::DOUBLE AS rare
       FROM tok t JOIN vz ON vz.lang = t.lang AND vz.form = t.form),
wf AS (SELECT doc_id, count(*) AS N, count(*) FILTER (WHERE content) AS content_n,
              count(*) FILTER (WHERE rare) AS rare_n,
              count(*) FILTER (WHERE rare AND upos = 'ADJ') AS rare_adj,
              count(*) FILTER (WHERE rare AND upos = 'ADV') AS rare_adv,
              count(*) FILTER (WHERE rare AND upos = 'NOUN') AS rare_noun,
              count(*) FILTER (WHERE rare AND upos = 'VERB') AS rare_verb,
              count(DISTINCT form) AS V, count(DISTINCT form) FILTER (WHERE content) AS V_content,
              count(DISTINCT form) FILTER (WHERE rare) AS V_rare
       FROM tz GROUP BY doc_id),
mz AS (SELECT doc_id, avg(m) AS min_wf FROM (SELECT doc_id, sent_id, min(zipf) AS m FROM tz GROUP BY doc_id, sent_id)
       GROUP BY doc_id),
wfd AS (SELECT d.doc_id, wf.*, mz.min_wf FROM d LEFT JOIN wf ON wf.doc_id = d.doc_id LEFT JOIN mz ON mz.doc_id = d.doc_id)"""
    cols = [("mean_distinct_rare", f"100.0::DOUBLE * {div('V_rare', 'V_content')}"),
            ("mean_rare", f"100.0::DOUBLE * {div('rare_n', 'content_n')}"),
            ("min_wf_per_sentence", "min_wf"),
            ("num_dif_rare_words_incidence", inc("V_rare")), ("num_different_forms_incidence", inc("V")),
            ("num_lexic_words_incidence", inc("content_n")), ("num_rare_adj_incidence", inc("rare_adj")),
            ("num_rare_advb_incidence", inc("rare_adv")), ("num_rare_nouns_incidence", inc("rare_noun")),
            ("num_rare_verbs_incidence", inc("rare_verb")), ("num_rare_words_incidence", inc("rare_n"))]
    return _with(token_ctes(), extra) + "\n" + out(cols, "wfd")


def semantic_values() -> str:
    rows = [f"({_q(lg)}, {_q(f)}, {n}, {h!r}::DOUBLE)" for lg, f, n, h in L.semantic_rows()]
    return f"sem(lang, form, n_senses, hyper_depth) AS (VALUES {', '.join(rows)})"


def q_m_semantics() -> str:
    extra = f"""
{semantic_values()},
se AS (SELECT d.doc_id,
              avg(s.hyper_depth) FILTER (WHERE t.upos IN ('NOUN', 'PROPN', 'VERB')) AS hypernymy_index,
              avg(s.hyper_depth) FILTER (WHERE t.upos IN ('NOUN', 'PROPN')) AS hypernymy_nouns_index,
              avg(s.hyper_depth) FILTER (WHERE t.upos = 'VERB') AS hypernymy_verbs_index,
              avg(s.n_senses) FILTER (WHERE t.content) AS polysemic_index
       FROM d LEFT JOIN tok t ON t.doc_id = d.doc_id
       LEFT JOIN sem s ON s.lang = t.lang AND s.form = t.form GROUP BY d.doc_id)"""
    names = ["hypernymy_index", "hypernymy_nouns_index", "hypernymy_verbs_index", "polysemic_index"]
    return _with(token_ctes(), extra) + "\n" + out([(n, n) for n in names], "se")
