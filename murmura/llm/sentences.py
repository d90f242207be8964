"""Sentence boundaries across languages and scripts, in SQL expressions.

A masked copy of the text, of the same length, has private-use placeholders where a mark cannot end a sentence
(decimals, addresses, initials, abbreviations, marks inside quotations, those inside others of the same marks included).
A terminator regex per script puts a separator behind each sentence; offsets are sums of the parts' lengths, and the sentences are cut from the stored text, which
restores what was masked. One scan, no Python, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.session import spread

MASK, LINE, CUT = "\ue000", "\ue001", "\ue00f"
#: Unicode white space, and the placeholder of a line break.
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + LINE

# Abbreviations before a name or a word, and those before a number.
TITLES = (
    "Dr Mr Mrs Ms Prof St Mt Sgt Capt Gen Rev Hon Sr Sra Srta Dra Dres Drs Mme Mlle MM Me Hr Fr Frl Dipl Ing Herr bzw ca vgl inkl evtl ggf sog z.B d.h u.a o.g i.d.R "
    "e.g i.e cf vs approx incl excl c.-à-d env p.ex т.е т.к т.д т.п тыс млн млрд см См ср напр им ул пр гр г-н проф акад डॉ श्री श्रीमती कु प्रो रु د أ م ص ق EE"
).split()
NUMBERED = "no No nos Nr nr Nrn fig Fig figs Figs p pp P S pág págs Pág art Art arts Abs vol Vol ch sec Sec Rd Ave ca approx env n nº núm num ann Bd Kap cap рис Рис п стр гл т табл ст № รูป Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
#: German words before an ordinal, and nouns after one.
ORDINAL_BEFORE = "am der die das dem den des im vom zum zur beim seit ab bis jeden".split()
ORDINAL_AFTER = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Quartal Abschnitt Kapitel Etage Stock Klasse Teil Platz Tag".split()
#: Words with which a sentence goes on after a closed quotation, in scripts without case.
GOES_ON_ZH = "然后 就 接着 随后 便 并 而后 之后 的 ， 、 ；".split()
GOES_ON_JA = "と って 、 。 で が は を の に も など という".split()
ROLES = "Speaker Sprecher Hablante Locuteur Orador Спикер 发言人 話者 ผู้พูด वक्ता المتحدث".split()

_MARKS = ".!?…。！？．।॥؟"
_CLOSE = r"[\"'”’“»›」』）)\]】*_\x{e003}]"
_OPEN = r"[\"“„«‹「『（(\[【‘*\x{e002}]"
_THAI = r"\x{e00}-\x{e7f}"
_CJK = r"\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}"


def _alt(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.\s?") for w in sorted(words, key=len, reverse=True))


#: A heading or a version's line: its end ends a sentence.
_HEADING = r"(?md)^([ \t]{0,9}(?:\#{1,6} |v\d{1,4}\.\d)[^\n]*+)\n"
#: Quotation marks (opening, closing, a condition behind the opening one); the plain one opens behind white space only.
QUOTES = (("„", "“”", ""), ("“", "”", r"(?<![\p{IsLatin}.!?…]“)"), ("«", "»", ""), ("‹", "›", ""), ("「", "」", ""), ("『", "』", ""), ('"', '"', rf"(?<![^\s(\[{LINE}]\")"))
#: Quotation marks of a quotation inside another one of the same marks.
INNER = "\ue002\ue003"


def _lines() -> str:
    """Line breaks that end a sentence: a blank line, before an item, a chat line or a speaker line."""
    item = rf"[ \t\x{{a0}}\x{{3000}}]*+(?:\#{{1,6}}\s|[-*•–—‣◦]\s|\d{{1,3}}[.)]\s|\d{{1,2}}:\d\d(?::\d\d)?\s+[^\s:]{{1,30}}(?:\s[^\s:]{{1,30}})?:|(?:\*\*)?\[\d{{1,3}}:\d\d|\*\*[^*\n]{{1,60}}:\*\*|(?:{'|'.join(ROLES)})\s?\d{{1,3}}\s?[:：]|(?:Me|Them)(?: \([^)\n]{{1,30}}\))?:\s)"
    return rf"\n(?:(?=[ \t\r\x{{a0}}\x{{3000}}]*+\n)|(?<!\b(?:der|die|das|dem|den|des|am|im|vom|zum) ?\n)(?={item}))"


def _plain() -> str:
    """A mark, one character, that ends no sentence: in decimals, addresses, initials, abbreviations and ordinals."""
    dots = [
        # list numbers at a line's start; abbreviations, initials, single letters
        r"(?<=(?:^|[\n\x{e001}])[ \t]{0,9}\d{1,3}.)",
        rf"(?<=(?:^|[^\p{{L}}\p{{M}}])(?:{_alt(TITLES)}).)(?=\s)",
        rf"(?<=(?:^|[^\p{{L}}\p{{M}}])(?:{_alt(NUMBERED)}).)(?=\s?\p{{N}})",
        r"(?<=(?:^|[^\p{L}\p{M}\p{N}’'])\p{Lu}.)(?=[\s-]?\p{Lu})",
        r"(?<=(?:^|[\s(\[.])\p{Ll}.)(?=\s)(?<![ap]\.m.)",
        # German ordinals
        rf"(?<=\b(?i:{'|'.join(ORDINAL_BEFORE)})\s\d{{1,3}}.)(?=\s\p{{Lu}})",
        rf"(?<=\d.)(?=\s(?:{'|'.join(ORDINAL_AFTER)})\b)",
    ]
    return rf"(?=[\x{{e004}}-\x{{e00f}}.?!．])(?:[\x{{e004}}-\x{{e00f}}]|[.?!](?=[\p{{Ll}}\p{{N}}])(?<=[\p{{L}}\p{{N}}/_=&-].)|．(?=\p{{N}})(?<=\p{{N}}.)|[.](?:{'|'.join(dots)}))"


def _quoted() -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Marks without which a step is skipped, and its patterns and replacements: they mask marks inside quotations.

    A match begins at an opening mark whose closing one follows in the same paragraph, or where the match before ended
    (``\\G``), and takes the text up to the next mark, however far; each pass is linear. The mark right before the
    closing quotation mark stays.
    """
    for o, c, when in QUOTES:
        out, on, steps = rf"[^{o}{c}{LINE}]*+", r"\G(?!\A)", []
        if c not in (o, "“”"):
            # a quotation inside one of the same marks: its marks give way to those of INNER
            steps.append((rf"((?:{o}{when}(?={out}(?:{o}{out}[{c}]{out})++[{c}])|{on}){out}){o}({out})[{c}]", rf"$1{INNER[0]}$2{INNER[1]}"))
        steps.append((rf"((?:{o}{when}(?={out}[{c}])|{on})[^{o}{c}{LINE}{_MARKS}]*+)[{_MARKS}](?![{_MARKS}]*+[\s\x{{a0}}]*+[{c}])", f"$1{MASK}"))
        yield o, steps
    # a quotation after which the sentence goes on, in scripts without case
    yield "」』”", [(rf"[{_MARKS}](?=[」』](?:{'|'.join(GOES_ON_JA)})|[”』」](?:{'|'.join(GOES_ON_ZH)}))", MASK)]
    yield "»”\"", [(rf"([:،,：]\s?[«“\"](?:[^»”\"{LINE}{_MARKS}]|[{_MARKS}](?![»”\"]))*+)[{_MARKS}](?=[»”\"]\s+[\x{{600}}-\x{{6ff}}\x{{900}}-\x{{97f}}])", f"$1{MASK}")]


def _cuts() -> str:
    """A pattern behind whose match a sentence ends. Groups repeat possessively: the engine recurses on others."""
    wide = rf"[。！？．।॥]++[{_MARKS}&&[^؟]]*+(?:[\s\x{{a0}}]*+[”’」』）】»{INNER[1]}]|[)\]\"*_])*+"
    upper = rf"(?:[*_#]*+{_OPEN}[*]?\s?[¿¡]?|[¿¡])?(?:[\p{{Lu}}\p{{Lt}}]|\p{{Ll}}{{1,8}}\p{{Lu}}\p{{Ll}})|[¿¡]"  # names such as eBook open sentences too
    caseless = rf"(?:{_OPEN}\s?)?(?:[\p{{Lo}}\p{{N}}]|v\d)|[#•*]|[-–—]\s|\p{{So}}"
    close = rf"(?:(?:[\s\x{{a0}}](?=»))?+{_CLOSE})*+"
    marks = [
        wide,
        rf"[.!?…؟]++{close}(?=[\s\x{{a0}}]++(?:{upper}))",
        rf"(?:[!?؟]++|(?<![.…])[.](?![.…])){close}(?=[\s\x{{a0}}]++(?:{caseless}))",
        # no space behind the mark
        rf"[.!?…](?<=(?:[\p{{Ll}}\p{{M}}]{{2}}|[\x{{e000}}.]m|[\p{{N}}%)”»\"]).){close}(?=[„“«]?\p{{Lu}}[\p{{Ll}}\s.{MASK}])",
        rf"[.!?؟](?<=[^.…].){close}(?=[{_CJK}&&[^，。、；：！？）」』”]])",
        LINE,
    ]
    # Thai: a space between Thai words, quotations included
    thai = rf"[{_THAI}&&[^ๆ]](?:(?<!ว่า)|[”\"»)])[ \n\r\x{{a0}}]++(?=[“\"(«]?[{_THAI}&&[^ๆ]])"
    return rf"((?=[{_MARKS}{LINE}])(?:{'|'.join(f'(?:{p})' for p in marks)})|{thai})"


def _marked(d: DataFrame, text: str, out: str) -> DataFrame:
    """``d`` with the marked copy of a text as ``out``; each step refers to the one before by name, so none is computed twice."""
    m = F.regexp_replace(F.replace(F.col(text), F.lit(LINE), F.lit(MASK)), _HEADING, f"$1{LINE}")
    d = d.withColumn(out, F.regexp_replace(F.regexp_replace(m, _lines(), LINE), _plain(), MASK))
    for signs, steps in _quoted():
        m = F.col(out)
        for pattern, to in steps:
            m = F.regexp_replace(m, pattern, to)
        d = d.withColumn(out, F.when(reduce(or_, [F.contains(F.col(text), F.lit(c)) for c in signs]), m).otherwise(F.col(out)))
    return d.withColumn(out, F.regexp_replace(out, _cuts(), f"$1{CUT}"))


def sentences(df: DataFrame, keys: dict[str, Column], text: str) -> DataFrame:
    """The ``keys``, ``sentence`` (from 0), ``start_char``, ``end_char`` (exclusive) and ``text`` of every sentence.

    Sentences have no white space at either end and cover all of the text but white space. Null, empty and blank texts
    give no rows; repeated rows give their sentences each; other columns of ``df`` are ignored.
    """
    block = 256  # running sums within blocks keep the cost of very long texts linear
    d = spread(df.filter(F.col(text).isNotNull()).select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("__text")))
    d = _marked(d, "__text", "__marked").withColumn("__parts", F.split("__marked", CUT)).drop("__marked")
    d = d.withColumn(
        "__cells",
        F.transform(
            "__parts",
            lambda p: F.struct(
                F.char_length(p).alias("n"),
                (F.char_length(p) - F.char_length(F.ltrim(p, F.lit(BLANK)))).alias("lead"),
                (F.char_length(p) - F.char_length(F.rtrim(p, F.lit(BLANK)))).alias("trail"),
            ),
        ),
    )
    d = d.withColumn("__blocks", F.transform(F.sequence(F.lit(0), ((F.size("__cells") - 1) / block).cast("int")), lambda b: F.slice("__cells", b * block + 1, block)))
    sizes = F.transform("__blocks", lambda cells: F.aggregate(cells, F.lit(0), lambda a, x: a + x.n))
    d = d.withColumn("__at", F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))))
    d = d.select(*keys, "__text", "__at", F.posexplode_outer("__blocks").alias("__b", "__cells"))  # outer: else the planner infers filters that repeat every expression
    first = F.element_at("__at", F.col("__b") + 1)
    # each block takes its own text out of the whole one; its sentences are cut from that
    d = d.select(*keys, first.alias("__first"), "__b", "__cells", F.substring("__text", first + 1, F.element_at("__at", F.col("__b") + 2) - first).alias("__text"))
    starts = F.aggregate("__cells", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.n)))
    spans = F.filter(F.arrays_zip(F.col("__cells"), F.slice(starts, 1, F.size("__cells")).alias("at")), lambda x: x["__cells"].n > x["__cells"].lead)
    d = d.select(*keys, "__text", "__first", "__b", F.posexplode_outer(F.transform(spans, lambda x: F.struct((x.at + x["__cells"].lead).alias("s"), (x.at + x["__cells"].n - x["__cells"].trail).alias("e")))).alias("__i", "__span"))
    d = d.filter("__span IS NOT NULL")
    return d.select(
        *keys,
        (F.col("__b").cast("bigint") * block + F.col("__i")).alias("sentence"),
        (F.col("__first") + F.col("__span.s")).cast("bigint").alias("start_char"),
        (F.col("__first") + F.col("__span.e")).cast("bigint").alias("end_char"),
        F.substring(F.col("__text"), F.col("__span.s") + 1, F.col("__span.e") - F.col("__span.s")).alias("text"),
    )
