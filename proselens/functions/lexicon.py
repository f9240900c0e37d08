"""Small fixed word tables used by the tagger and the metric definitions.

The tables are Python literals so that the same values feed both the Spark
expressions (hash-set membership tests) and the DuckDB oracle (``VALUES``).
Large tables (corpus vocabulary, word frequencies) are never kept here: they
are DataFrames computed from the corpus.
"""

from __future__ import annotations

from functools import lru_cache

LANGS = ("en", "es", "fr", "de")

# ---------------------------------------------------------------------------
# FIXED VALUES: closed-class words per language.
# One entry per line: ``form UPOS [Feature=Value|...]``.  Lemma = form.
# Every word listed here is also a stopword.  ``Polarity=Neg`` marks negations.
# ---------------------------------------------------------------------------
CLOSED_CLASS = {
    "en": """
the DET
a DET
an DET
this DET
that DET
these DET
those DET
some DET
any DET
every DET
each DET
no DET Polarity=Neg
i PRON PronType=Prs|Person=1|Number=Sing
me PRON PronType=Prs|Person=1|Number=Sing
we PRON PronType=Prs|Person=1|Number=Plur
us PRON PronType=Prs|Person=1|Number=Plur
you PRON PronType=Prs|Person=2|Number=Sing
he PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
him PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
she PRON PronType=Prs|Person=3|Number=Sing|Gender=Fem
her PRON PronType=Prs|Person=3|Number=Sing|Gender=Fem
it PRON PronType=Prs|Person=3|Number=Sing|Gender=Neut
they PRON PronType=Prs|Person=3|Number=Plur
them PRON PronType=Prs|Person=3|Number=Plur
who PRON PronType=Rel
which PRON PronType=Rel
nothing PRON Polarity=Neg
nobody PRON Polarity=Neg
of ADP
in ADP
to ADP
for ADP
on ADP
with ADP
by ADP
at ADP
from ADP
as ADP
into ADP
about ADP
over ADP
under ADP
between ADP
through ADP
during ADP
without ADP
and CCONJ
or CCONJ
but CCONJ
nor CCONJ Polarity=Neg
because SCONJ
if SCONJ
when SCONJ
while SCONJ
although SCONJ
since SCONJ
unless SCONJ
whether SCONJ
is AUX Tense=Pres|Mood=Ind
are AUX Tense=Pres|Mood=Ind
am AUX Tense=Pres|Mood=Ind
has AUX Tense=Pres|Mood=Ind
have AUX Tense=Pres|Mood=Ind
does AUX Tense=Pres|Mood=Ind
do AUX Tense=Pres|Mood=Ind
was AUX Tense=Past|Mood=Ind|Irregular=Yes
were AUX Tense=Past|Mood=Ind|Irregular=Yes
had AUX Tense=Past|Mood=Ind|Irregular=Yes
did AUX Tense=Past|Mood=Ind|Irregular=Yes
be AUX VerbForm=Inf
been AUX VerbForm=Part
being AUX VerbForm=Ger
will AUX
would AUX
can AUX
could AUX
should AUX
may AUX
might AUX
must AUX
said VERB Tense=Past|Mood=Ind|Irregular=Yes
went VERB Tense=Past|Mood=Ind|Irregular=Yes
made VERB Tense=Past|Mood=Ind|Irregular=Yes
took VERB Tense=Past|Mood=Ind|Irregular=Yes
came VERB Tense=Past|Mood=Ind|Irregular=Yes
saw VERB Tense=Past|Mood=Ind|Irregular=Yes
knew VERB Tense=Past|Mood=Ind|Irregular=Yes
gave VERB Tense=Past|Mood=Ind|Irregular=Yes
found VERB Tense=Past|Mood=Ind|Irregular=Yes
thought VERB Tense=Past|Mood=Ind|Irregular=Yes
told VERB Tense=Past|Mood=Ind|Irregular=Yes
became VERB Tense=Past|Mood=Ind|Irregular=Yes
let VERB Mood=Imp
not ADV Polarity=Neg
never ADV Polarity=Neg
very ADV
also ADV
only ADV
just ADV
then ADV
there ADV
here ADV
now ADV
still ADV
even ADV
too ADV
one NUM
two NUM
three NUM
four NUM
five NUM
ten NUM
""",
    "es": """
el DET
la DET
los DET
las DET
un DET
una DET
unos DET
unas DET
este DET
esta DET
estos DET
estas DET
ese DET
esa DET
su DET
sus DET
mi DET
mis DET
ningún DET Polarity=Neg
ninguna DET Polarity=Neg
yo PRON PronType=Prs|Person=1|Number=Sing
me PRON PronType=Prs|Person=1|Number=Sing
nosotros PRON PronType=Prs|Person=1|Number=Plur|Gender=Masc
nosotras PRON PronType=Prs|Person=1|Number=Plur|Gender=Fem
nos PRON PronType=Prs|Person=1|Number=Plur
tú PRON PronType=Prs|Person=2|Number=Sing
te PRON PronType=Prs|Person=2|Number=Sing
vosotros PRON PronType=Prs|Person=2|Number=Plur|Gender=Masc
él PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
ella PRON PronType=Prs|Person=3|Number=Sing|Gender=Fem
ellos PRON PronType=Prs|Person=3|Number=Plur|Gender=Masc
ellas PRON PronType=Prs|Person=3|Number=Plur|Gender=Fem
le PRON PronType=Prs|Person=3|Number=Sing
les PRON PronType=Prs|Person=3|Number=Plur
lo PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
se PRON PronType=Prs|Person=3
nada PRON Polarity=Neg
nadie PRON Polarity=Neg
de ADP
en ADP
a ADP
por ADP
para ADP
con ADP
sin ADP
sobre ADP
entre ADP
desde ADP
hasta ADP
hacia ADP
del ADP
al ADP
y CCONJ
e CCONJ
o CCONJ
u CCONJ
pero CCONJ
ni CCONJ Polarity=Neg
sino CCONJ
que SCONJ
porque SCONJ
si SCONJ
cuando SCONJ
aunque SCONJ
mientras SCONJ
como SCONJ
donde SCONJ
es AUX Tense=Pres|Mood=Ind
son AUX Tense=Pres|Mood=Ind
está AUX Tense=Pres|Mood=Ind
están AUX Tense=Pres|Mood=Ind
ha AUX Tense=Pres|Mood=Ind
han AUX Tense=Pres|Mood=Ind
hay AUX Tense=Pres|Mood=Ind
era AUX Tense=Past|Mood=Ind
había AUX Tense=Past|Mood=Ind
fue AUX Tense=Past|Mood=Ind|Irregular=Yes
fueron AUX Tense=Past|Mood=Ind|Irregular=Yes
ser AUX VerbForm=Inf
estar AUX VerbForm=Inf
sido AUX VerbForm=Part
hizo VERB Tense=Past|Mood=Ind|Irregular=Yes
dijo VERB Tense=Past|Mood=Ind|Irregular=Yes
tuvo VERB Tense=Past|Mood=Ind|Irregular=Yes
puso VERB Tense=Past|Mood=Ind|Irregular=Yes
vino VERB Tense=Past|Mood=Ind|Irregular=Yes
dio VERB Tense=Past|Mood=Ind|Irregular=Yes
vio VERB Tense=Past|Mood=Ind|Irregular=Yes
mira VERB Mood=Imp
no ADV Polarity=Neg
nunca ADV Polarity=Neg
jamás ADV Polarity=Neg
tampoco ADV Polarity=Neg
muy ADV
más ADV
también ADV
ya ADV
bien ADV
aquí ADV
ahora ADV
dos NUM
tres NUM
cuatro NUM
cinco NUM
diez NUM
""",
    "fr": """
le DET
la DET
les DET
l DET
un DET
une DET
des DET
du DET
au DET
aux DET
ce DET
cet DET
cette DET
ces DET
son DET
sa DET
ses DET
mon DET
ma DET
leur DET
aucun DET Polarity=Neg
aucune DET Polarity=Neg
je PRON PronType=Prs|Person=1|Number=Sing
j PRON PronType=Prs|Person=1|Number=Sing
me PRON PronType=Prs|Person=1|Number=Sing
moi PRON PronType=Prs|Person=1|Number=Sing
nous PRON PronType=Prs|Person=1|Number=Plur
tu PRON PronType=Prs|Person=2|Number=Sing
te PRON PronType=Prs|Person=2|Number=Sing
vous PRON PronType=Prs|Person=2|Number=Plur
il PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
elle PRON PronType=Prs|Person=3|Number=Sing|Gender=Fem
ils PRON PronType=Prs|Person=3|Number=Plur|Gender=Masc
elles PRON PronType=Prs|Person=3|Number=Plur|Gender=Fem
on PRON PronType=Prs|Person=3|Number=Sing
lui PRON PronType=Prs|Person=3|Number=Sing
eux PRON PronType=Prs|Person=3|Number=Plur|Gender=Masc
se PRON PronType=Prs|Person=3
qui PRON PronType=Rel
rien PRON Polarity=Neg
personne PRON Polarity=Neg
de ADP
à ADP
en ADP
dans ADP
par ADP
pour ADP
sur ADP
avec ADP
sans ADP
sous ADP
entre ADP
vers ADP
chez ADP
et CCONJ
ou CCONJ
mais CCONJ
ni CCONJ Polarity=Neg
car CCONJ
donc CCONJ
que SCONJ
quand SCONJ
si SCONJ
comme SCONJ
lorsque SCONJ
puisque SCONJ
est AUX Tense=Pres|Mood=Ind
sont AUX Tense=Pres|Mood=Ind
a AUX Tense=Pres|Mood=Ind
ont AUX Tense=Pres|Mood=Ind
était AUX Tense=Past|Mood=Ind
étaient AUX Tense=Past|Mood=Ind
avait AUX Tense=Past|Mood=Ind
fut AUX Tense=Past|Mood=Ind|Irregular=Yes
furent AUX Tense=Past|Mood=Ind|Irregular=Yes
être AUX VerbForm=Inf
avoir AUX VerbForm=Inf
été AUX VerbForm=Part
fit VERB Tense=Past|Mood=Ind|Irregular=Yes
dit VERB Tense=Past|Mood=Ind|Irregular=Yes
prit VERB Tense=Past|Mood=Ind|Irregular=Yes
vint VERB Tense=Past|Mood=Ind|Irregular=Yes
vit VERB Tense=Past|Mood=Ind|Irregular=Yes
mit VERB Tense=Past|Mood=Ind|Irregular=Yes
regarde VERB Mood=Imp
ne ADV Polarity=Neg
pas ADV Polarity=Neg
jamais ADV Polarity=Neg
plus ADV
très ADV
aussi ADV
bien ADV
déjà ADV
encore ADV
ici ADV
deux NUM
trois NUM
quatre NUM
cinq NUM
dix NUM
""",
    "de": """
der DET
die DET
das DET
den DET
dem DET
des DET
ein DET
eine DET
einen DET
einem DET
einer DET
eines DET
dieser DET
diese DET
dieses DET
seine DET
ihre DET
kein DET Polarity=Neg
keine DET Polarity=Neg
keinen DET Polarity=Neg
ich PRON PronType=Prs|Person=1|Number=Sing
mich PRON PronType=Prs|Person=1|Number=Sing
mir PRON PronType=Prs|Person=1|Number=Sing
wir PRON PronType=Prs|Person=1|Number=Plur
uns PRON PronType=Prs|Person=1|Number=Plur
du PRON PronType=Prs|Person=2|Number=Sing
dich PRON PronType=Prs|Person=2|Number=Sing
dir PRON PronType=Prs|Person=2|Number=Sing
er PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
sie PRON PronType=Prs|Person=3|Number=Plur
es PRON PronType=Prs|Person=3|Number=Sing|Gender=Neut
ihn PRON PronType=Prs|Person=3|Number=Sing|Gender=Masc
ihm PRON PronType=Prs|Person=3|Number=Sing
sich PRON PronType=Prs|Person=3
nichts PRON Polarity=Neg
niemand PRON Polarity=Neg
in ADP
von ADP
zu ADP
mit ADP
auf ADP
für ADP
an ADP
bei ADP
nach ADP
aus ADP
über ADP
unter ADP
um ADP
durch ADP
gegen ADP
ohne ADP
vor ADP
zwischen ADP
im ADP
am ADP
zum ADP
zur ADP
vom ADP
und CCONJ
oder CCONJ
aber CCONJ
denn CCONJ
sondern CCONJ
dass SCONJ
weil SCONJ
wenn SCONJ
ob SCONJ
obwohl SCONJ
als SCONJ
während SCONJ
bevor SCONJ
nachdem SCONJ
ist AUX Tense=Pres|Mood=Ind
sind AUX Tense=Pres|Mood=Ind
hat AUX Tense=Pres|Mood=Ind
haben AUX Tense=Pres|Mood=Ind
wird AUX Tense=Pres|Mood=Ind
werden AUX Tense=Pres|Mood=Ind
war AUX Tense=Past|Mood=Ind|Irregular=Yes
waren AUX Tense=Past|Mood=Ind|Irregular=Yes
hatte AUX Tense=Past|Mood=Ind|Irregular=Yes
hatten AUX Tense=Past|Mood=Ind|Irregular=Yes
wurde AUX Tense=Past|Mood=Ind|Irregular=Yes
sein AUX VerbForm=Inf
kann AUX
muss AUX
soll AUX
ging VERB Tense=Past|Mood=Ind|Irregular=Yes
kam VERB Tense=Past|Mood=Ind|Irregular=Yes
sah VERB Tense=Past|Mood=Ind|Irregular=Yes
gab VERB Tense=Past|Mood=Ind|Irregular=Yes
nahm VERB Tense=Past|Mood=Ind|Irregular=Yes
fand VERB Tense=Past|Mood=Ind|Irregular=Yes
sprach VERB Tense=Past|Mood=Ind|Irregular=Yes
stand VERB Tense=Past|Mood=Ind|Irregular=Yes
komm VERB Mood=Imp
nicht ADV Polarity=Neg
nie ADV Polarity=Neg
niemals ADV Polarity=Neg
sehr ADV
auch ADV
noch ADV
schon ADV
nur ADV
hier ADV
jetzt ADV
dann ADV
zwei NUM
drei NUM
vier NUM
fünf NUM
zehn NUM
""",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: connectives per language, ``phrase | class``.
# A phrase may be listed under several classes; it then counts once in each
# class and once in the all-connectives count.
# ---------------------------------------------------------------------------
CONNECTIVES = {
    "en": """
because | causal
since | causal
since | temporal
so | causal
therefore | causal
therefore | logical
thus | logical
hence | logical
as a result | causal
due to | causal
consequently | causal
or | logical
either | logical
in fact | logical
but | adversative
however | adversative
although | adversative
though | adversative
yet | adversative
whereas | adversative
on the other hand | adversative
nevertheless | adversative
instead | adversative
then | temporal
when | temporal
before | temporal
after | temporal
while | temporal
until | temporal
meanwhile | temporal
finally | temporal
and | additive
also | additive
moreover | additive
furthermore | additive
in addition | additive
if | conditional
unless | conditional
provided that | conditional
in case | conditional
""",
    "es": """
porque | causal
ya que | causal
por lo tanto | causal
por eso | causal
así que | causal
debido a | causal
o | logical
por consiguiente | logical
es decir | logical
pero | adversative
sin embargo | adversative
aunque | adversative
no obstante | adversative
sino | adversative
cuando | temporal
mientras | temporal
antes | temporal
después | temporal
luego | temporal
finalmente | temporal
y | additive
además | additive
también | additive
si | conditional
a menos que | conditional
en caso de que | conditional
""",
    "fr": """
parce que | causal
car | causal
donc | causal
donc | logical
ainsi | logical
par conséquent | causal
ou | logical
c est à dire | logical
mais | adversative
cependant | adversative
pourtant | adversative
bien que | adversative
toutefois | adversative
quand | temporal
lorsque | temporal
avant | temporal
après | temporal
puis | temporal
enfin | temporal
et | additive
aussi | additive
de plus | additive
en outre | additive
si | conditional
à moins que | conditional
""",
    "de": """
weil | causal
da | causal
deshalb | causal
daher | causal
also | logical
oder | logical
folglich | logical
aber | adversative
jedoch | adversative
obwohl | adversative
trotzdem | adversative
sondern | adversative
wenn | temporal
wenn | conditional
als | temporal
bevor | temporal
nachdem | temporal
dann | temporal
und | additive
auch | additive
außerdem | additive
falls | conditional
sofern | conditional
""",
}

CONNECTIVE_CLASSES = ("causal", "logical", "adversative", "temporal", "additive", "conditional")

# ---------------------------------------------------------------------------
# FIXED VALUES: open-class suffix rules, applied in this order after the
# closed-class lookup (first match wins).  ``(pattern, UPOS, features)``.
# ---------------------------------------------------------------------------
SUFFIX_RULES = (
    ("(mente|ment|ly|lich)$", "ADV", ""),
    ("(ción|tion|dad|ung|heit|keit)$", "NOUN", ""),
    ("(ado|ed|é)$", "VERB", "Tense=Past|Mood=Ind"),
    ("(ing|ando|iendo)$", "VERB", "VerbForm=Ger"),
    ("(ar|er|ir)$", "VERB", "VerbForm=Inf"),
    ("(able|ible|oso|eux)$", "ADJ", ""),
)
# Remaining words: NOUN when at least this many letters long, else X.
NOUN_MIN_LETTERS = 4

# FIXED VALUES: text conventions shared by both engines.
PARA_SPLIT = r"\n+"
SENT_SPLIT = r"[.!?…]+"
LETTER = r"\p{L}"
WORD = r"\p{L}+"
PUNCT = r"\p{P}"
SYLLABLE_ES = r"[iuü]?[aáeéoó][iuü]?|[íú]|[iuü]+"
SYLLABLE_OTHER = r"[aeiouyàâäáéèêëíîïóôöúùûü]+"
# Light stemmer: strip one of these endings when at least 3 letters remain.
STEM_SUFFIX = r"(ciones|ción|tion|ment|mente|ing|ed|es|en|er|ar|ir|s|e|a|o)$"
STEM_MIN_LETTERS = 3
# Open-class number and gender by ending.
PLURAL_SUFFIX = r"(s|x)$"
FEM_SUFFIX = {"es": r"a$", "fr": r"e$"}
MASC_SUFFIX = {"es": r"o$"}

CONTENT_UPOS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
MTLD_THRESHOLD = 0.72
RARE_ZIPF = 4.0

# FIXED VALUES: an illustrative semantic lexicon ``lang form n_senses hyper_depth``.
# Real use passes a WordNet-style export as a DataFrame instead.
SEMANTIC_LEXICON = """
en time 10 6
en way 12 5
en work 7 7
en make 49 3
en take 42 3
es tiempo 9 6
es forma 8 5
es hacer 20 3
fr temps 8 6
fr faire 25 3
de zeit 6 6
de machen 10 3
"""


def _parse_feats(s: str) -> dict:
    return dict(kv.split("=", 1) for kv in s.split("|") if kv)


@lru_cache(maxsize=None)
def closed_class_rows() -> tuple:
    """Rows ``(lang, form, upos, feats dict)`` in file order."""
    out = []
    for lang in LANGS:
        for line in CLOSED_CLASS[lang].strip().splitlines():
            parts = line.split()
            form, upos = parts[0], parts[1]
            feats = _parse_feats(parts[2]) if len(parts) > 2 else {}
            out.append((lang, form, upos, feats))
    return tuple(out)


@lru_cache(maxsize=None)
def connective_rows() -> tuple:
    """Rows ``(lang, phrase, n_words, class)``."""
    out = []
    for lang in LANGS:
        for line in CONNECTIVES[lang].strip().splitlines():
            phrase, cls = (x.strip() for x in line.split("|"))
            out.append((lang, phrase, len(phrase.split()), cls))
    return tuple(out)


@lru_cache(maxsize=None)
def semantic_rows() -> tuple:
    out = []
    for line in SEMANTIC_LEXICON.strip().splitlines():
        lang, form, senses, depth = line.split()
        out.append((lang, form, int(senses), float(depth)))
    return tuple(out)


def keys_where(pred) -> list[str]:
    """``lang|form`` keys of closed-class rows satisfying ``pred(upos, feats)``."""
    return sorted({f"{lang}|{form}" for lang, form, upos, feats in closed_class_rows() if pred(upos, feats)})
