"""Metric-to-group maps of the two metric families.

Both maps are contract values: the metric names and their groups, in file order.
"""

from __future__ import annotations

from functools import lru_cache

# ---------------------------------------------------------------------------
# FIXED VALUES: family C metric -> group map (48 rows, file order).
# ---------------------------------------------------------------------------
FAMILY_C_GROUPS = """
metric,group
DESPC,DESCRIPTIVE
DESSC,DESCRIPTIVE
DESWC,DESCRIPTIVE
DESPL,DESCRIPTIVE
DESPLd,DESCRIPTIVE
DESSL,DESCRIPTIVE
DESSLd,DESCRIPTIVE
DESWLsy,DESCRIPTIVE
DESWLsyd,DESCRIPTIVE
DESWLlt,DESCRIPTIVE
DESWLltd,DESCRIPTIVE
WRDNOUN,WORD INFORMATION
WRDVERB,WORD INFORMATION
WRDADJ,WORD INFORMATION
WRDADV,WORD INFORMATION
WRDPRO,WORD INFORMATION
WRDPRP1s,WORD INFORMATION
WRDPRP1p,WORD INFORMATION
WRDPRP2s,WORD INFORMATION
WRDPRP2p,WORD INFORMATION
WRDPRP3s,WORD INFORMATION
WRDPRP3p,WORD INFORMATION
DRNP,SYNTACTIC PATTERN DENSITY
DRVP,SYNTACTIC PATTERN DENSITY
DRNEG,SYNTACTIC PATTERN DENSITY
SYNNP,SYNTACTIC COMPLEXITY
SYNLE,SYNTACTIC COMPLEXITY
CNCAll,CONNECTIVES
CNCCaus,CONNECTIVES
CNCLogic,CONNECTIVES
CNCADC,CONNECTIVES
CNCTemp,CONNECTIVES
CNCAdd,CONNECTIVES
LDTTRa,LEXICAL DIVERSITY
LDTTRcw,LEXICAL DIVERSITY
RDFHGL,READABILITY
CRFNO1,REFERENTIAL COHESION
CRFAO1,REFERENTIAL COHESION
CRFSO1,REFERENTIAL COHESION
CRFCWO1,REFERENTIAL COHESION
CRFCWO1d,REFERENTIAL COHESION
CRFANP1,REFERENTIAL COHESION
CRFNOa,REFERENTIAL COHESION
CRFAOa,REFERENTIAL COHESION
CRFSOa,REFERENTIAL COHESION
CRFCWOa,REFERENTIAL COHESION
CRFCWOad,REFERENTIAL COHESION
CRFANPa,REFERENTIAL COHESION
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: family M metric -> group map (98 rows, file order).
# ---------------------------------------------------------------------------
FAMILY_M_GROUPS = """
metric,group
adj_density,LEXICAL DIVERSITY
adj_ttr,LEXICAL DIVERSITY
adv_density,LEXICAL DIVERSITY
adv_ttr,LEXICAL DIVERSITY
adversative_connectives_incidence,CONNECTIVES
all_connectives_incidence,CONNECTIVES
argument_overlap_adjacent,REFERENTIAL COHESION
argument_overlap_all,REFERENTIAL COHESION
causal_connectives_incidence,CONNECTIVES
conditional_connectives_incidence,CONNECTIVES
content_overlap_adjacent_mean,REFERENTIAL COHESION
content_overlap_adjacent_std,REFERENTIAL COHESION
content_overlap_all_mean,REFERENTIAL COHESION
content_overlap_all_std,REFERENTIAL COHESION
content_ttr,LEXICAL DIVERSITY
flesch,READABILITY
gerund_incidence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
honore,LEXICAL DIVERSITY
hypernymy_index,WORD SEMANTIC INFORMATION
hypernymy_nouns_index,WORD SEMANTIC INFORMATION
hypernymy_verbs_index,WORD SEMANTIC INFORMATION
infinitive_incidence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
left_embeddedness,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
lemma_adj_ttr,LEXICAL DIVERSITY
lemma_adv_ttr,LEXICAL DIVERSITY
lemma_content_ttr,LEXICAL DIVERSITY
lemma_nttr,LEXICAL DIVERSITY
lemma_ttr,LEXICAL DIVERSITY
lemma_vttr,LEXICAL DIVERSITY
lemmas_length_mean,DESCRIPTIVE
lemmas_length_std,DESCRIPTIVE
lexical_density,LEXICAL DIVERSITY
logical_connectives_incidence,CONNECTIVES
maas,LEXICAL DIVERSITY
mean_depth_per_sentence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
mean_distinct_rare,WORD FREQUENCY
mean_np_per_sentence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
mean_propositions_per_sentence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
mean_rare,WORD FREQUENCY
mean_vp_per_sentence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
min_wf_per_sentence,WORD FREQUENCY
mtld,LEXICAL DIVERSITY
negation_incidence,LEXICAL DIVERSITY
noun_density,LEXICAL DIVERSITY
noun_overlap_adjacent,REFERENTIAL COHESION
noun_overlap_all,REFERENTIAL COHESION
noun_phrase_density_incidence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
nttr,LEXICAL DIVERSITY
num_adj_incidence,WORD MORPHOLOGICAL INFORMATION
num_adv_incidence,WORD MORPHOLOGICAL INFORMATION
num_decendents_noun_phrase,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
num_dif_rare_words_incidence,WORD FREQUENCY
num_different_forms_incidence,WORD FREQUENCY
num_first_pers_pron_incidence,WORD MORPHOLOGICAL INFORMATION
num_first_pers_sing_pron_incidence,WORD MORPHOLOGICAL INFORMATION
num_impera_incidence,WORD MORPHOLOGICAL INFORMATION
num_indic_incidence,WORD MORPHOLOGICAL INFORMATION
num_lexic_words_incidence,WORD FREQUENCY
num_modifiers_noun_phrase,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
num_noun_incidence,WORD MORPHOLOGICAL INFORMATION
num_paragraphs_incidence,DESCRIPTIVE
num_past_incidence,WORD MORPHOLOGICAL INFORMATION
num_past_irregular_incidence,WORD MORPHOLOGICAL INFORMATION
num_past_irregular_mean,WORD MORPHOLOGICAL INFORMATION
num_personal_pronouns_incidence,WORD MORPHOLOGICAL INFORMATION
num_pres_incidence,WORD MORPHOLOGICAL INFORMATION
num_proper_noun_incidence,WORD MORPHOLOGICAL INFORMATION
num_punct_marks_per_sentence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
num_rare_adj_incidence,WORD FREQUENCY
num_rare_advb_incidence,WORD FREQUENCY
num_rare_nouns_incidence,WORD FREQUENCY
num_rare_verbs_incidence,WORD FREQUENCY
num_rare_words_incidence,WORD FREQUENCY
num_sentences_incidence,DESCRIPTIVE
num_subord_incidence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
num_syllables_words_mean,DESCRIPTIVE
num_syllables_words_std,DESCRIPTIVE
num_third_pers_pron_incidence,WORD MORPHOLOGICAL INFORMATION
num_verb_incidence,WORD MORPHOLOGICAL INFORMATION
polysemic_index,WORD SEMANTIC INFORMATION
ratio_proper_nouns_per_nouns,WORD MORPHOLOGICAL INFORMATION
sentences_length_mean,DESCRIPTIVE
sentences_length_no_stopwords_mean,DESCRIPTIVE
sentences_length_no_stopwords_std,DESCRIPTIVE
sentences_length_std,DESCRIPTIVE
sentences_per_paragraph_mean,DESCRIPTIVE
sentences_per_paragraph_std,DESCRIPTIVE
simple_ttr,LEXICAL DIVERSITY
stem_overlap_adjacent,REFERENTIAL COHESION
stem_overlap_all,REFERENTIAL COHESION
temporal_connectives_incidence,CONNECTIVES
verb_density,LEXICAL DIVERSITY
verb_phrase_density_incidence,SYNTACTIC COMPLEXITY & SYNTACTIC PATTERN DENSITY
vttr,LEXICAL DIVERSITY
words_length_mean,DESCRIPTIVE
words_length_no_stopwords_mean,DESCRIPTIVE
words_length_no_stopwords_std,DESCRIPTIVE
words_length_std,DESCRIPTIVE
"""

FAMILIES = {"coh_metrix": FAMILY_C_GROUPS, "multiazter": FAMILY_M_GROUPS}


@lru_cache(maxsize=None)
def group_rows() -> tuple:
    """Rows ``(family, pos, metric, group)``; ``pos`` is the 0-based file position."""
    out = []
    for fam, text in FAMILIES.items():
        lines = text.strip().splitlines()[1:]
        for pos, line in enumerate(lines):
            metric, group = line.split(",", 1)
            out.append((fam, pos, metric, group))
    return tuple(out)


def metrics_of(family: str, group: str | None = None) -> list[str]:
    return [m for f, _, m, g in group_rows() if f == family and (group is None or g == group)]


def groups_of(family: str) -> list[str]:
    return sorted({g for f, _, _, g in group_rows() if f == family})


def csv_text(family: str) -> str:
    return FAMILIES[family].strip() + "\n"
