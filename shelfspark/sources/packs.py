"""The dimension of language packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, English label, script family, recogniser (none, or the script's) and ISO 639-1 code of each pack, in
# the order in which ties are resolved.
PACKS = """
rus|Russian|CYRILLIC|NONE|ru
bel|Belarusian|CYRILLIC|NONE|be
ukr|Ukrainian|CYRILLIC|NONE|uk
bul|Bulgarian|CYRILLIC|NONE|bg
srp|Serbian (Cyrillic)|CYRILLIC|NONE|sr
mkd|Macedonian|CYRILLIC|NONE|mk
kaz|Kazakh|CYRILLIC|NONE|kk
kir|Kyrgyz|CYRILLIC|NONE|ky
tgk|Tajik|CYRILLIC|NONE|tg
tat|Tatar|CYRILLIC|NONE|tt
aze_cyrl|Azerbaijani (Cyrillic)|CYRILLIC|NONE|az
uzb_cyrl|Uzbek (Cyrillic)|CYRILLIC|NONE|uz
mon|Mongolian|CYRILLIC|NONE|mn
eng|English|LATIN|NONE|en
deu|German|LATIN|NONE|de
fra|French|LATIN|NONE|fr
spa|Spanish|LATIN|NONE|es
ita|Italian|LATIN|NONE|it
por|Portuguese|LATIN|NONE|pt
pol|Polish|LATIN|NONE|pl
nld|Dutch|LATIN|NONE|nl
ces|Czech|LATIN|NONE|cs
slk|Slovak|LATIN|NONE|sk
hun|Hungarian|LATIN|NONE|hu
ron|Romanian|LATIN|NONE|ro
swe|Swedish|LATIN|NONE|sv
nor|Norwegian|LATIN|NONE|nb
dan|Danish|LATIN|NONE|da
fin|Finnish|LATIN|NONE|fi
est|Estonian|LATIN|NONE|et
lav|Latvian|LATIN|NONE|lv
lit|Lithuanian|LATIN|NONE|lt
slv|Slovenian|LATIN|NONE|sl
hrv|Croatian|LATIN|NONE|hr
bos|Bosnian|LATIN|NONE|bs
srp_latn|Serbian (Latin)|LATIN|NONE|sr
cat|Catalan|LATIN|NONE|ca
glg|Galician|LATIN|NONE|gl
eus|Basque|LATIN|NONE|eu
tur|Turkish|LATIN|NONE|tr
aze|Azerbaijani|LATIN|NONE|az
uzb|Uzbek|LATIN|NONE|uz
vie|Vietnamese|LATIN|NONE|vi
ind|Indonesian|LATIN|NONE|id
msa|Malay|LATIN|NONE|ms
swa|Swahili|LATIN|NONE|sw
afr|Afrikaans|LATIN|NONE|af
isl|Icelandic|LATIN|NONE|is
gle|Irish|LATIN|NONE|ga
gla|Scottish Gaelic|LATIN|NONE|gd
cym|Welsh|LATIN|NONE|cy
mlt|Maltese|LATIN|NONE|mt
sqi|Albanian|LATIN|NONE|sq
epo|Esperanto|LATIN|NONE|eo
lat|Latin|LATIN|NONE|la
fil|Filipino|LATIN|NONE|tl
hat|Haitian Creole|LATIN|NONE|ht
ceb|Cebuano|LATIN|NONE|
jav|Javanese|LATIN|NONE|jv
sun|Sundanese|LATIN|NONE|su
bre|Breton|LATIN|NONE|br
cos|Corsican|LATIN|NONE|co
fao|Faroese|LATIN|NONE|fo
fry|Frisian|LATIN|NONE|fy
kmr|Kurdish (Latin)|LATIN|NONE|
ltz|Luxembourgish|LATIN|NONE|lb
mri|Maori|LATIN|NONE|mi
oci|Occitan|LATIN|NONE|oc
que|Quechua|LATIN|NONE|qu
ton|Tongan|LATIN|NONE|to
yor|Yoruba|LATIN|NONE|yo
ell|Greek|GREEK|NONE|el
grc|Ancient Greek|GREEK|NONE|
hye|Armenian|ARMENIAN|NONE|hy
kat|Georgian|GEORGIAN|NONE|ka
ara|Arabic|ARABIC|NONE|ar
fas|Persian|ARABIC|NONE|fa
urd|Urdu|ARABIC|NONE|ur
pus|Pashto|ARABIC|NONE|ps
uig|Uyghur|ARABIC|NONE|ug
snd|Sindhi|ARABIC|NONE|sd
heb|Hebrew|HEBREW|NONE|he
yid|Yiddish|HEBREW|NONE|yi
chi_sim|Chinese (Simplified)|CJK|CHINESE|zh
chi_tra|Chinese (Traditional)|CJK|CHINESE|zh
jpn|Japanese|CJK|JAPANESE|ja
kor|Korean|CJK|KOREAN|ko
hin|Hindi|INDIC|NONE|hi
ben|Bengali|INDIC|NONE|bn
tam|Tamil|INDIC|NONE|ta
tel|Telugu|INDIC|NONE|te
kan|Kannada|INDIC|NONE|kn
mal|Malayalam|INDIC|NONE|ml
guj|Gujarati|INDIC|NONE|gu
pan|Punjabi|INDIC|NONE|pa
ori|Odia|INDIC|NONE|or
sin|Sinhala|INDIC|NONE|si
nep|Nepali|INDIC|NONE|ne
mar|Marathi|INDIC|NONE|mr
san|Sanskrit|INDIC|NONE|sa
asm|Assamese|INDIC|NONE|as
tha|Thai|OTHER|NONE|th
lao|Lao|OTHER|NONE|lo
khm|Khmer|OTHER|NONE|km
mya|Burmese|OTHER|NONE|my
amh|Amharic|OTHER|NONE|am
tir|Tigrinya|OTHER|NONE|ti
bod|Tibetan|OTHER|NONE|bo
dzo|Dzongkha|OTHER|NONE|dz
chr|Cherokee|OTHER|NONE|
"""
ROWS = [(i, *line.split("|")) for i, line in enumerate(PACKS.strip().splitlines())]
SCHEMA = "ordinal int, id string, label string, family string, recogniser string, iso6391 string"


def packs(spark: SparkSession) -> DataFrame:
    """ordinal, id, label, family, recogniser, iso6391 of the 110 packs."""
    return spark.createDataFrame(ROWS, SCHEMA)


def duckdb_values() -> str:
    """The dimension as DuckDB SQL."""
    rows = ", ".join("(" + ", ".join([str(r[0]), *(f"'{v}'" for v in r[1:])]) + ")" for r in ROWS)
    return f"SELECT ordinal::INT AS ordinal, id, label, family, recogniser, iso6391 FROM (VALUES {rows}) p(ordinal, id, label, family, recogniser, iso6391)"
