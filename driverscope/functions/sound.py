"""How English words sound: Double Metaphone keys, computed once per distinct word of an Arrow batch."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

# The published rules of Double Metaphone for single words. A rule is a letter, a pattern that begins there (what
# stands before it in lookbehinds), the sounds of the main and of the other reading (_ for none), and how many letters it uses
# up. The first rule that fits counts. Marks before a pattern: + only in Slavic or Germanic words, - only in
# others, * only in words that begin with SCH.
RULES = r"""
B BB P P 2
B B P P 1
C (?<=[^AEIOUY]A)CH(?![IE]) K K 2
C (?<=[BM]A)CHER K K 2
C ^CAESAR S S 2
C CHIA K K 2
C (?<=.)CHAE K X 2
C ^CH(?:ARAC|ARIS|YM|IA|EM|OR(?!E)) K K 2
C *CH K K 2
C (?<=OR)CHES|(?<=AR)CHIT|(?<=OR)CHID|CH[TS] K K 2
C ^CH[LRNMBHFVW]|(?<=[AOUE])CH[LRNMBHFVW] K K 2
C (?<=^M)CH K K 2
C ^CH X X 2
C CH X K 2
C (?<!WI)CZ S X 2
C CCIA X X 3
C (?<=^A)CC(?:[IE]|H(?!U)) KS KS 3
C (?<=U)CCE[ES] KS KS 3
C (?<!^M)CC(?:[IE]|H(?!U)) X X 3
C (?<!^M)CC K K 2
C C[KGQ] K K 2
C CI[OEA] S X 2
C C[IEY] S S 2
C CC(?![EI]) K K 2
C C K K 1
D DG[IEY] J J 3
D DG TK TK 2
D D[TD] T T 2
D D T T 1
F FF F F 2
F F F F 1
G (?<=[^AEIOUY])GH K K 2
G ^GHI J J 2
G ^GH K K 2
G (?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH _ _ 2
G (?<=[CGLRT].U)GH F F 2
G (?<=[^I])GH K K 2
G GH _ _ 2
G -(?<=^[AEIOUY])GN KN N 2
G -GN(?!EY) N KN 2
G GN KN KN 2
G -GLI KL L 2
G ^G(?:Y|E[SPBLYRI]|I[BLNE]) K J 2
G (?<!^DAN)(?<!^RAN)(?<!^MAN)(?<![EI])GER K J 2
G (?<![EIRO])GY K J 2
G *G[EIY] K K 2
G GET K K 2
G GIER$ J J 2
G G[EIY]|(?<=[AO])GGI J K 2
G GG K K 2
G G K K 1
H (?<![^AEIOUY])H[AEIOUY] H H 2
H H _ _ 1
J ^JOSE$ H H 1
J JOSE J H 1
J ^JJ J A 2
J ^J J A 1
J -(?<=[AEIOUY])J[AO] J H 1
J J$ J _ 1
J (?<![SKL])JJ J J 2
J (?<![SKL])J(?![LTKSNMBZ]) J J 1
J JJ _ _ 2
J J _ _ 1
K KK K K 2
K K K K 1
L (?<=I)LL[OA]$|(?<=A)LLE$ L _ 2
L (?<=A)LLE(?=.*(?:[AO]S|[AO])$) L _ 2
L LL L L 2
L L L L 1
M MM|(?<=U)MB(?:$|ER) M M 2
M M M M 1
N NN N N 2
N N N N 1
P PH F F 2
P P[PB] P P 2
P P P P 1
Q QQ K K 2
Q Q K K 1
R -(?<!M[EA]IE)(?<=IE)R$ _ R 1
R RR R R 2
R R R R 1
S (?<=[IY])SL _ _ 1
S ^SUGAR X S 1
S SH(?:EIM|OEK|OLM|OLZ) S S 2
S SH X X 2
S -SI[OA] S X 3
S SI[OA] S S 3
S SZ S X 2
S ^S[MNLW] S X 1
S SCHE[RN] X SK 3
S SCH(?:OO|UY|ED|EM) SK SK 3
S ^SCH(?![AEIOUYW]) X S 3
S SCH X X 3
S SC[IEY] S S 3
S SC SK SK 3
S (?<=[AO]I)S$ _ S 1
S S[SZ] S S 2
S S S S 1
T TION|TIA|TCH X X 3
T TH[OA]M T T 2
T *TH T T 2
T TH|TTH 0 T 2
T T[TD] T T 2
T T T T 1
V VV F F 2
V V F F 1
W WR R R 2
W ^W[AEIOUY] A F 1
W ^WH A A 1
W *W _ F 1
W (?<=[AEIOUY])W$|(?<=[EO])WSK[IY] _ F 1
W WI[CT]Z TS FX 4
W W _ _ 1
X ^X S S 1
X (?<=[IE]AU)X$|(?<=[AO]U)X$ _ _ 1
X X[CX] KS KS 2
X X KS KS 1
Z ZH J J 2
Z ZZ[OIA] S TS 2
Z +(?<=[^T])ZZ S TS 2
Z +(?<=[^T])Z S TS 1
Z ZZ S S 2
Z Z S S 1
"""
SLAVIC = re.compile("W|K|CZ|WITZ")
#: Beginnings whose first letter is not spoken.
SILENT = re.compile("GN|KN|PN|WR|PS")
VOWELS = frozenset("AEIOUY")


def _rules() -> dict[str, list[tuple[str, re.Pattern, str, str, int]]]:
    table: dict[str, list[tuple[str, re.Pattern, str, str, int]]] = {}
    for line in RULES.split("\n"):
        if line:
            letter, pattern, main, other, used = line.split(" ")
            mark = pattern[0] if pattern[0] in "+-*" else ""
            main, other = (s.replace("_", "") for s in (main, other))
            table.setdefault(letter, []).append((mark, re.compile(pattern.removeprefix(mark)), main, other, int(used)))
    return table


LETTERS = _rules()


def double_metaphone(word: str) -> tuple[str, str]:
    """Main and other key of a single word; letters with accents count as without, other signs are passed over."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.upper()) if unicodedata.category(c) != "Mn")
    slavic = SLAVIC.search(plain) is not None
    holds = {"": True, "+": slavic, "-": not slavic, "*": plain.startswith("SCH")}
    at, main, other = 1 if SILENT.match(plain) else 0, "", ""
    while at < len(plain):
        letter = plain[at]
        if letter in VOWELS:
            if at == 0:
                main = other = "A"
            at += 1
            continue
        for mark, pattern, first, second, used in LETTERS.get(letter, ()):
            if holds[mark] and pattern.match(plain, at):
                main, other, at = main + first, other + second, at + used
                break
        else:
            at += 1
    return main, other


def sound(word: str) -> str:
    return double_metaphone(word)[0]


def twice(word: str) -> str:
    """The key of a word's key: the study compares keys through a function that takes them for words again."""
    return sound(sound(word))


def with_sounds(rows: DataFrame, columns: Mapping[str, Column], repeated: bool = True) -> DataFrame:
    """All columns and, by name, the keys of arrays of words; NULL arrays and words stay NULL.

    Each distinct word of an Arrow batch is taken apart once and the keys are dealt out by its dictionary, so the cost follows the
    vocabulary. ``repeated`` gives the key of the key, as the study compares.
    """
    key, names = twice if repeated else sound, list(columns)
    worded = rows.select("*", *[c.cast("array<string>").alias(n) for n, c in columns.items()])
    schema = T.StructType(rows.schema.fields + [T.StructField(n, T.ArrayType(T.StringType())) for n in names])

    def keyed(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        keys = pa.array([None if w is None else key(w) for w in words.dictionary.to_pylist()], pa.string())
        sizes = [0 if n is None else n for n in lists.value_lengths().to_pylist()]
        ends = pa.array([0, *_running(sizes)], pa.int32())
        return pa.ListArray.from_arrays(ends, keys.take(words.indices), mask=lists.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - len(names))]
            found = [keyed(batch.column(i)) for i in range(batch.num_columns - len(names), batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=batch.schema.names)

    return worded.mapInArrow(run, schema)


def _running(sizes: list[int]) -> Iterator[int]:
    total = 0
    for size in sizes:
        total += size
        yield total
