"""Personal information in free text: found on a normalised copy, mapped back to the stored characters.

Transducers rewrite a text step by step (composition, width, digits of other scripts, homoglyphs, spelled digits,
disguised at and dot) and carry for every character the place it came from. Detectors run on the result; spans map back,
so placeholders replace exactly what stands in the text. Rows are independent: one scan, no shuffle, as long as the
words of known names are few enough to be sent out, which is checked; beyond, each text's own words are joined to them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.session import cut, spread

TYPES = ("name", "email", "phone", "id_number", "address")
#: Most distinct names that are sent to the workers; of more, each text gets those of its words that are names by joins.
NAMES_SENT = 500_000

# Homoglyphs of Latin letters, digits in words, disguises of at and dot.
_HOMO = dict(zip("аеорсухіѕјԁһӏАВЕКМНОРСТХУІЅЈοανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdhlABEKMHOPCTXYISJoavptuikABEZHIKMNOPTYX"))
_DIGIT_WORDS = (
    "zero oh null cero nul ноль zéro,one eins uno un um один,two zwei dos deux dois два,three drei tres trois três три,four vier cuatro quatre quatro четыре,"
    "five fünf cinco cinq пять,six sechs seis шесть,seven sieben siete sept sete семь,eight acht ocho huit oito восемь,nine neun nueve neuf nove девять"
)
DIGIT_WORD = {w: str(i) for i, ws in enumerate(_DIGIT_WORDS.split(",")) for w in ws.split()}
CJK_DIGIT = dict(zip("〇零一二三四五六七八九幺", "001234567891"))
AT = r"at|arroba|ät|klammeraffe|arobase|chiocciola|собака|アットマーク"
DOT = r"dot|punkt|punto|ponto|point|точка|ドット"

_ZERO = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


@dataclass
class Mapped:
    """A text and, for every character, the start of its source; ``end`` closes the last one."""

    text: str
    at: list[int] | range
    end: int

    def sub(self, pattern: re.Pattern, to) -> Mapped:
        """Matches rewritten by ``to(match)``: pairs (offset in the match, characters)."""
        out, at, last = [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            out.append(self.text[last : m.start()])
            at += self.at[last : m.start()]
            for off, s in new:
                out.append(s)
                at += [self.at[m.start() + off]] * len(s)
            last = m.end()
        if not out:
            return self
        out.append(self.text[last:])
        at += self.at[last:]
        return Mapped("".join(out), at, self.end)

    def span(self, a: int, b: int, source: str) -> tuple[int, int]:
        """Source span of text[a:b]."""
        s = self.at[a]
        e = self.at[b] if b < len(self.at) else self.end
        while e > s and source[e - 1].isspace():
            e -= 1
        return s, e


_PLAIN = re.compile(r"[\x00-\x7f¡-¬®-˿Ѐ-҂Ҋ-ԯ฀-๏ऀ-॥ء-ٟ—-‧‰-⁞、-ヿ一-鿿]*")
_MIXED = re.compile(r"(?=[\w.+-]*[a-zA-Z])(?=[\w.+-]*[Ͱ-ϿЀ-ӿ])[\w.+-]+")


def fold_chars(text: str) -> Mapped:
    """Composed characters, ASCII digits and signs for full-width and other scripts' ones, homoglyphs, no zero-width marks."""
    if _PLAIN.fullmatch(text):
        m = Mapped(text, range(len(text)), len(text))
    else:
        out: list[str] = []
        at: list[int] = []
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            if ord(c) in _ZERO:
                i += 1
                continue
            j = i + 1
            if ord(c) < 0x250 or 0x370 <= ord(c) < 0x530:
                while j < n and "̀" <= text[j] <= "ͯ":
                    j += 1
            s = unicodedata.normalize("NFC", text[i:j])
            if "＀" <= c <= "￯":
                s = unicodedata.normalize("NFKC", c)
            elif (d := unicodedata.decimal(c, None)) is not None:
                s = str(d)
            elif c in "‐‑‒–−":
                s = "-"
            elif c in "﹫":
                s = "@"
            elif unicodedata.category(c) == "Zs":
                s = " "
            out.append(s)
            at += [i] * len(s)
            i = j
        m = Mapped("".join(out), at, n)
    return m if not _MAY_MIX.search(m.text) else m.sub(_MIXED, lambda x: [(k, _HOMO.get(c, c)) for k, c in enumerate(x.group())])


_DW = "|".join(sorted(DIGIT_WORD, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:double|triple)[ -])?(?:{_DW})(?:[ ,-]+(?:(?:double|triple)[ -])?(?:{_DW})){{5,}}(?!\w)", re.I)
_SPELLED_CJK = re.compile(rf"[{''.join(CJK_DIGIT)}]{{7,}}")
_WORDS = re.compile(r"\w+")


def _digits(m: re.Match) -> list[tuple[int, str]]:
    out, times = [], 1
    for w in _WORDS.finditer(m.group()):
        word = w.group().lower()
        if word in ("double", "triple"):
            times, first = (2 if word == "double" else 3), w.start()
            continue
        out.append((w.start() if times == 1 else first, DIGIT_WORD[word] * times))
        times = 1
    return out


_L = r"[A-Za-z0-9À-ɏ_%+-]+"
#: An address with a bracketed or named at and dots in words.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9À-ɏ_%+.-])(?P<local>{_L}(?:(?:\s(?:{DOT})\s|\s?[\[({{]\s?(?:{DOT}|\.)\s?[\])}}]\s?|\.){_L})*)"
    rf"(?:\s?[\[({{<]\s?(?:{AT}|@)\s?[\])}}>]\s?|\s(?:{AT})\s|\s?@\s?)"
    rf"(?P<host>{_L}(?:(?:\s(?:{DOT})\s|\s?[\[({{]\s?(?:{DOT}|\.)\s?[\])}}]\s?|\.){_L})+)(?![A-Za-z0-9À-ɏ_%+-])(?!\s?@|\s?[\[({{<]\s?(?:{AT}|@)\s?[\])}}>]|\s(?:{AT})\s{_L}\s(?:{DOT})\s)",
    re.I,
)
_DOT_WORD = re.compile(rf"\s(?:{DOT})\s", re.I)
#: Cheap signs without which a step is skipped.
_MAY_MIX = re.compile(r"[Ͱ-ϿЀ-ӿ][A-Za-z]|[A-Za-z][Ͱ-ϿЀ-ӿ]")


def _plain_address(m: re.Match) -> list[tuple[int, str]] | None:
    s = m.group()
    if not re.search(r"[@\[({<]", s) and not _DOT_WORD.search(m.group("host")):
        return None  # "meet at nine.thirty": a bare at needs a dot in words
    out, seen = [], False
    for w in re.finditer(rf"{_L}|\S", s):
        word, lone = w.group(), w.group().lower()
        inside_local = w.end() <= len(m.group("local"))
        if word in "()[]{}<>":
            continue
        if not inside_local and not seen and (lone == "@" or re.fullmatch(AT, lone)):
            out.append((w.start(), "@"))
            seen = True
        elif re.fullmatch(DOT, lone) and w.start() > 0 and w.end() < len(s):
            out.append((w.start(), "."))
        else:
            out.append((w.start(), word))
    return out


def normalise(text: str, gated: bool = True) -> tuple[Mapped, set[str] | None, set[int], list[int] | None]:
    """The detectors' copy of a text, and what it may hold (:func:`signs`): everything unless ``gated``."""
    m = folded = fold_chars(text)
    may, address, cues = signs(_lower(m.text)) if gated else ({"spelled", "at", "kin"}, {*range(len(ADDRESS))}, None)
    if "spelled" in may:
        m = m.sub(_SPELLED, _digits)
    m = m.sub(_SPELLED_CJK, lambda x: [(i, CJK_DIGIT[c]) for i, c in enumerate(x.group())])
    if "at" in may:
        m = m.sub(_DISGUISED, _plain_address)
    if m is not folded and gated:  # rewritten: the places have moved
        cues = signs(_lower(m.text))[2]
    return m, may, address, cues


EMAIL = re.compile(r"(?<![A-Za-z0-9À-ɏ_%+-])(?<![A-Za-z0-9À-ɏ_%+-]\.)[A-Za-z0-9À-ɏ_%+-]+(?:\.[A-Za-z0-9À-ɏ_%+-]+)*\s?@\s?[A-Za-z0-9À-ɏ-]+(?:\.[A-Za-z0-9À-ɏ-]+)*\.[A-Za-z]{2,}")

# Cue words before a number, by what the number is.
CUES = {
    "id_number": r"passport|passeport|pasaporte|passaporte|reisepass|паспорт\w*|護照|护照|旅券番号|パスポート|พาสปอร์ต|หนังสือเดินทาง|पासपोर्ट|जواز|جواز|social(?: security)?|ssn|\bids?\b|identity|driver\S* licen[cs]e|national insurance|ausweis\w*|steuer-?\s?id\w*|steuernummer|sozialversicherung\w*|personalausweis|sécurité sociale|carte d'identité|\bnir\b|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|\brg\b|cartão de cidadão|снилс|инн|удостоверени\w*|身份证号?码?|社会保障号|マイナンバー|免許証?番号|個人番号|บัตรประชาชน\S{0,8}|आधार|पहचान संख्या|पैन|الهوية|رقم الهوية",
    "phone": r"\bcall\b|phone|\bmobile\b|\bcell\b|\bfax\b|\btel\b|telefon\w*|teléfono|telefone|téléphone|numéro|nummer|number|appelez|ruft|ligu\w+|llam\w+|móvil|handy|телефон\w*|звони\w*|номер|电话|電話|手机|携帯|เบอร์|โทร|नंबर|फ़ोन|رقمي|هاتف|اتصل\w*",
    "": r"order|ticket|batch|build|version|port|room|raum|sala|salle|lot|lote|auftrag|bestellung|artikelnummer|artikel|rechnung\w*|invoice no|pedido|commande|facture|range|issue|case|заказ\w*|счёт|订单|編號|编号|注文番号|注文|คำสั่งซื้อ|ऑर्डर|الطلب|طلب|№ заказа|serial|part number|flight|isbn|account for",
}
_CUE = re.compile("|".join(rf"(?P<c{i}>{p})" for i, p in enumerate(CUES.values())), re.I)
_KINDS = list(CUES)
#: A number with its separators, or letters and digits together.
NUMBER = re.compile(r"(?<![A-Za-z0-9_@.])(?:\+\s?\d{1,3}[\s./-]?)?(?:\(\d{1,4}\)\s?)?\d++(?:(?:\s?[-./]\s?|\s|(?<=\))|(?=\())\(?\d++\)?)*(?![\d@])")
_DIGIT = re.compile(r"\d")
ID_VALUE = re.compile(r"(?<![A-Za-z0-9_])(?=[\w .\-№]{0,24}\d)(?:[A-Z]{1,3}(?=[ \d])|[A-Z]?\d[0-9A-Z]*|[A-Z]{1,3}\d[0-9A-Z]*)(?:[ .\-/]?(?:№\s?)?(?:\d[0-9A-Z]*|[A-Z](?![a-z])\d*(?![\w])))*")
ID_LOWER = re.compile(r"(?<![A-Za-z0-9_])(?:[a-z]{1,3}\s?)?\d[0-9a-z]*(?:[ .\-/]?(?:№\s?)?\d[0-9a-z]*)*")
STRONG = re.compile(r"\+\d|\(0\d{1,4}\)\s?\d{3,4}[ -]?\d{3,4}$|\(\d{2,4}\)\s?\d{3,4}-\d{4}$|\d{3}\.\d{3}\.\d{4}$|0\d{2,4}[-/ ]|1\d{10}$|0\d(?: \d\d){4}$|8 ?\(\d{3}\)")

# Kinds of streets by language.
_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Drive|Dr|Way|Close|Square|Sq|Place|Pl|Terrace|Crescent|Grove|Row|Walk|Gardens|Hill|Boulevard|Blvd|Brewery|Mews|Parade|Yard)"
_TEENS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety"
_W = r"[A-Z][\w’'-]*"
ADDRESS = [
    re.compile(p, f)
    for p, f in [
        (rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Studio)\.? \d+\w?, )?(?:(?:\d+[A-Za-z]?(?:[-/]\d+)?|(?:{_TEENS.replace(' ', '|')})(?:-\w+)?)(?: {_W}){{1,3}} {_EN}\b)", 0),
        (rf"(?:Flat|Apt|Apartment|Unit|Suite)\.? \d+\w?, (?:The )?{_W}(?: {_W}){{0,3}}", 0),
        (rf"\b\d+[a-z]? (?:[a-z'’-]+ ){{1,3}}(?:street|road|lane|avenue|court|drive)\b|\b(?:{_TEENS.replace(' ', '|')})(?: [a-z'’-]+){{1,2}} (?:court|street|road|lane|avenue)\b", 0),
        (r"\bP\.?\s?O\.? Box \d+|\bPostfach \d+|\bpo box \d+", 0),
        (r"(?:(?:Alte[rs]?|Neue[rs]?|Am|An der|Auf der|Zum|Zur|Im|Obere|Untere|Große|Kleine|Hintere|Vordere) )?\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|winkel|stieg|hof|steig|markt|graben|berg|tor)\s\d+\s?[a-z]?\b(?:-\d+)?", 0),
        (r"\b\d+(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|bd|chemin|place|impasse|quai|allée|route|cours|passage|square|sentier)\b[^.,;\n]{2,40}|\b(?:rue|avenue|boulevard|chemin|impasse|quai|allée) (?:de |du |des |de la |d'|l')[^.,;\n\d]{2,30},? \d+", re.I),
        (r"(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|carretera)\s(?:(?:de|del|de la|de las|de los)\s)?[^.,;\n\d]{2,30},?\s?(?:n\.?º\s?)?\d+", re.I),
        (r"(?<!\w)(?:rua|av\.|avenida|travessa|praça|largo|estrada|alameda|rodovia)\s(?:(?:de|do|da|das|dos)\s)?[^.,;\n\d]{2,30},?\s?(?:n\.?º\s?)?\d+", re.I),
        (r"(?<!\w)(?:г\. ?[А-ЯЁ][\w-]+, ?)?(?:ул\.|улица|пер\.|переулок|просп\.|проспект|пр-т|наб\.|набережная|шоссе|бульвар|пл\.|площадь)\s?[А-ЯЁ][\w-]+(?: [\w-]+)?,? (?:д\. ?|дом )?\d+|[А-ЯЁ][\w-]+(?:ый|ая|ий|ое|ой) (?:проезд|переулок|улица|проспект|тупик|бульвар|шоссе|набережная|площадь),? (?:д\. ?)?\d+", 0),
        (r"〒\s?\d{3}-\d{4}\s?[一-龥ヶケノ々]*", 0),
        (r"(?<=は)[一-龥ヶケノ々]{1,5}(?:都|道|府|県|市|区|町|村)[一-龥ぁ-んァ-ヶノ々]{0,10}\d+(?:丁目|番地?|号|-)[\d\-丁目番地号]*", 0),
        (r"[一-龥]{2,4}(?:省|市|县|镇|自治区)(?:[一-龥]{1,5}(?:区|县|镇|乡))?[一-龥]{1,6}(?:大道|路|街|巷|道|弄|胡同)\d+号", 0),
        (r"(?:บ้านเลขที่|เลขที่)\s?\d+(?:/\d+)?\s?(?:ซอย|ถนน|หมู่)\S+|\d+(?:/\d+)?\s(?:ซอย|ถนน|หมู่)\S+", 0),
        (r"(?:मकान (?:नं\.?|संख्या)?\s?)?\d+(?:/\d+)?, ?[ऀ-ॿ]+ (?:मार्ग|गली|सड़क|रोड|नगर|चौक|पथ)", 0),
        (r"(?<!\w)\d+ (?:شارع|طريق|زقاق|نهج) [؀-ۿ]+|(?:شارع|طريق|زقاق|نهج) [؀-ۿ]+(?: [؀-ۿ]+)?,? (?:رقم )?\d+", 0),
    ]
]
#: Of each pattern in ADDRESS, substrings of which a match has at least one; as words of their own after a bar.
_ADDRESS_SIGNS = (
    f"| {_EN[3:-1].replace('|', ' ').lower()}",
    "flat apt apartment unit suite",
    "street road lane avenue court drive",
    "box postfach",
    "straße strasse str. weg platz gasse allee ufer ring damm winkel stieg hof steig markt graben berg tor",
    "rue avenue boulevard chemin place impasse quai allée route cours passage square sentier | bd",
    "calle c/ avenida avda plaza paseo camino ronda travesía carretera",
    "rua av. avenida travessa praça largo estrada alameda rodovia",
    "ул. улица переул пер. просп пр-т наб шоссе бульвар пл. площадь проезд тупик",
    "〒",
    "都 道 府 県 市 区 町 村",
    "号",
    "ซอย ถนน หมู่",
    "मार्ग गली सड़क रोड नगर चौक पथ",
    "شارع طريق زقاق نهج",
)
#: Patterns in ADDRESS that may do without a digit (numbers in words).
_IN_WORDS = (0, 2)


def _signs():
    import ahocorasick

    auto = ahocorasick.Automaton()
    kinds: dict[str, set[tuple[str, object]]] = {}
    for i, ws in enumerate(_ADDRESS_SIGNS):
        loose, _, alone = ws.partition("|")
        for w in loose.split():
            kinds.setdefault(w, set()).add(("address", i))
        for w in alone.split():
            kinds.setdefault(w, set()).add(("address word", i))
    for w in DIGIT_WORD:
        kinds.setdefault(w, set()).add(("spelled", 1))
    for w in (*DOT.split("|"), *AT.split("|")):
        if w != "at":  # a bare one needs a dot in words or brackets; bracketed ones: see signs()
            kinds.setdefault(w, set()).add(("at word", 1))
    for w in "[({<":
        kinds.setdefault(w, set()).add(("bracket", 1))
    kinds.setdefault("@", set()).add(("at", 1))
    for w in _KIN.split("|"):
        kinds.setdefault(w, set()).add(("kin", 1))
    for p in CUES.values():
        for w in p.split("|"):  # what each cue begins with
            w = re.match(r"(?:\\b)?((?:[^\\\[(?*{]+(?![?*{])|[^\\\[(?*{](?=[^?*{]))+)", w).group(1)
            kinds.setdefault(w, set()).add(("cue", 1))
    for w, k in kinds.items():
        auto.add_word(w, (len(w), tuple(k)))
    auto.make_automaton()
    return auto


_SIGNS: list = []


def _alone(low: str, before: int, after: int) -> bool:
    """No letter, digit or underscore at either place."""
    return not any(0 <= i < len(low) and (low[i].isalnum() or low[i] == "_") for i in (before, after))


def signs(low: str) -> tuple[set[str], set[int], list[int]]:
    """What a lower-case text may hold ('spelled', 'at', 'kin'), the patterns of addresses, and where cues may begin.

    Six spelled digits are the least.
    """
    if not _SIGNS:
        _SIGNS.append(_signs())
    out: set[str] = set()
    address: set[int] = set()
    cues: list[int] = []
    spelled = 0
    for end, (size, kinds) in _SIGNS[0].iter(low):
        for k, i in kinds:
            if k == "cue":
                cues.append(end - size + 1)
            elif k == "address":
                address.add(i)
            elif k == "spelled":
                spelled += 1
            elif k == "bracket":
                if low[end + 1 : end + 4].lstrip().startswith(("at", ".")):
                    out.add("at")
            elif k.endswith(" word"):
                if not _alone(low, end - size, end + 1):
                    continue
                if k == "address word":
                    address.add(i)
                else:
                    out.add(k[:-5])
            else:
                out.add(k)
    return out | {"spelled"} if spelled >= 6 else out, address, cues


def _cues(t: str, places: list[int] | None) -> Iterator[re.Match]:
    """Matches of the cues, from the left, without overlap; ``places`` are all places where one may begin, None if unknown."""
    if places is None:
        yield from _CUE.finditer(t)
        return
    at = 0
    for p in sorted({*places}):
        if p >= at and (m := _CUE.match(t, p)):
            yield m
            at = m.end()


_ZH_CUE = re.compile(r"^.*(?:寄到|寄往|送到|住在|搬到|地址是|地址为|位于|在|到|是)")
TITLE = re.compile(
    r"(?<!\w)(?:Herrn?|Frau|Mr\.?|Mrs\.?|Ms\.?|Miss|Mme|Mlle|Monsieur|Madame|Dr\.|Prof\.|Sr\.|Sra\.|Srta\.|Dra\.|Don|Doña|señor|señora|senhora?|господин|госпожа|г-н|г-жа)\s+((?:[A-ZÀ-ÞА-Я]\.\s?)*(?:(?:Du|De|Van|Von|Le|La|El|Mc|O['’])\s?)?[A-ZÀ-ÞА-Я][\w’'-]+(?:\s(?:(?:Du|De|Van|Von|Le|La|El)\s)?[A-ZÀ-ÞА-Я][\w’'-]+){0,2})"
)
_KIN = (
    "colleague|boss|manager|friend|wife|husband|brother|sister|neighbour|neighbor|assistant|kollege|kollegin|kollegen|chef|chefin|freund|freundin|nachbar|nachbarin"
    "|collègue|cheffe|ami|amie|voisin|voisine|colega|jefe|jefa|amigo|amiga|vecino|vecina|chefe|vizinho|vizinha|коллега|друг|подруга|начальник"
)
#: A first and a last name behind a word for a person.
KIN = re.compile(
    r"(?<!\w)(?i:my|our|his|her|their|mein(?:e[nm]?)?|unser(?:e[nm]?)?|mon|ma|notre|mi|nuestr[oa]|meu|minha|мой|моя|наш|наша)\s"
    rf"(?i:{_KIN})\s"
    r"([A-ZÀ-ÞА-ЯЁ][\w’'-]+(?:\s(?:(?:Du|De|Van|Von|Le|La|El)\s)?[A-ZÀ-ÞА-ЯЁ][\w’'-]+){1,2})"
)
_NOT_NAMES = frozenset("the a an i we you it monday tuesday wednesday thursday friday project".split())
#: A head of two or three capitalised words before a colon.
HEAD = re.compile(r"^[^\w]*(?:[\[(<]?[\d:.,hms> -]+[\])>]?\s*)?(?:\*\*|<b>)?([A-ZÀ-ÞА-ЯЁ][\w’'-]+(?:\s[A-ZÀ-ÞА-ЯЁ][\w’'-]+){1,2})(?:</b>)?\s?[:：]")


@dataclass
class Names:
    """Known names: an automaton over their words, folded; CJK names also by learnt halves."""

    words: list[str]
    first: set[str] = field(default_factory=set)
    heads: set[str] = field(default_factory=set)
    tails: set[str] = field(default_factory=set)

    def __post_init__(self):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for w in {*self.words, *self.heads}:
            self.auto.add_word(w, w)
        if self.words or self.heads:
            self.auto.make_automaton()
        self.known = set(self.words)

    def __reduce__(self):
        return Names, (self.words, self.first, self.heads, self.tails)

    def find(self, low: str) -> list[tuple[int, int]]:
        """Spans of words of names, longest first at each place, none inside a longer word of its script."""
        if not self.words and not self.heads:
            return []
        hits = []
        for e, w in self.auto.iter(low):
            a, b = e - len(w) + 1, e + 1
            kind = _script(w[0])
            if kind in ("cased", "joined") and (a and _script(low[a - 1]) == kind or b < len(low) and _script(low[b]) == kind):
                continue
            if w in self.heads:
                b += next((k for k in (3, 2, 1) if low[b : b + k] in self.tails), 0)
                if b == e + 1 and w not in self.known:
                    continue
            hits.append((a, b))
        out: list[tuple[int, int]] = []
        for a, b in sorted(hits, key=lambda h: (h[0], -h[1])):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out


def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha() and unicodedata.category(c) not in ("Mn", "Mc"):
        return ""
    if o < 0x530:
        return "cased"
    if 0x600 <= o < 0x780 or 0x900 <= o < 0xE00:
        return "joined"
    return "free"


def name_words(shown: list[str]) -> Names:
    """Words of display names: the first word and the rest of each; a name without spaces whole and in its learnt halves."""
    words: set[str] = set()
    first: set[str] = set()
    solid: set[str] = set()
    for s in shown:
        parts = unicodedata.normalize("NFC", s).lower().split()
        if not parts:
            continue
        if len(parts) == 1:
            (solid if _script(parts[0][0]) == "free" else words).add(parts[0])
            first.add(parts[0])
        else:
            words |= {parts[0], " ".join(parts[1:])}
            first.add(parts[0])
            if all(_script(p[0]) == "free" for p in parts):
                solid.add("".join(parts))
    words |= solid
    # halves of names without spaces: heads with several tails, and those all of whose tails belong to such heads
    by_head: dict[str, set[str]] = {}
    for s in solid:
        if len(s) <= 6:
            for k in (2, 3):
                if 0 < len(s) - k <= 3:
                    by_head.setdefault(s[:k], set()).add(s[k:])
    heads = {h for h, t in by_head.items() if len(t) > 1}
    tails = set().union(*[by_head[h] for h in heads])
    heads |= {h for h, t in by_head.items() if t <= tails}
    return Names(sorted(w for w in words if len(w) > 1), first, heads, tails)


_INITIAL = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.\s?){1,2}$")


def find(text: str, names: Names, gated: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, type) of every value, by start; spans do not overlap.

    Detectors whose signs a text lacks are skipped when ``gated``; the result is the same without.
    """
    m, may, address, places = normalise(text, gated)
    t = m.text
    taken: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y, _ in taken)
    if "@" in t or not gated:
        for x in EMAIL.finditer(t):
            taken.append((x.start(), x.end(), "email"))
    digits = len(_DIGIT.findall(t))
    if gated and not digits:
        address = address & {*_IN_WORDS}
    if address:
        found: list[tuple[int, int]] = []
        for p in sorted(address):
            for x in ADDRESS[p].finditer(t):
                a, b = x.span()
                if "一" <= t[a] <= "鿿" and (cut := _ZH_CUE.match(t[a : a + 6])) and t[a + cut.end() : a + cut.end() + 1]:
                    a += cut.end()
                found.append((a, b))
        for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
            if not free(a, b):
                continue
            if taken and taken[-1][2] == "address" and re.fullmatch(r",?\s?", t[taken[-1][1] : a]):
                taken[-1] = (taken[-1][0], b, "address")
            else:
                taken.append((a, b, "address"))
    if not gated or digits > 3:
        cues = [(x.end(), _KINDS[int(x.lastgroup[1:])], x.start()) for x in _cues(t, places)]
        for end, kind, start in cues:  # letters and digits after the word for a document
            if kind != "id_number":
                continue
            tail = t[end : end + 60]
            x = next((y for y in ID_VALUE.finditer(tail) if sum(c.isdigit() for c in y.group()) >= 4), None) or next((y for y in ID_LOWER.finditer(tail) if sum(c.isdigit() for c in y.group()) >= 5), None)
            if x and x.start() <= 24 and not re.search(r"[.!?。！？]\s", tail[: x.start()]) and free(end + x.start(), end + x.end()):
                a, b = end + x.start(), end + len(tail[: x.end()].rstrip(" .-/"))
                if not tail[x.start() : x.start() + 1] == "+":
                    taken.append((a, b, "id_number"))
        for x in NUMBER.finditer(t):
            s = x.group().rstrip(" .-/(")
            count = sum(c.isdigit() for c in s)
            a, b = x.start(), x.start() + len(s)
            if count < 7 or count > 15 or not free(a, b):
                continue
            near = [(e, k) for e, k, _ in cues if e <= a and a - e <= 30 and not re.search(r"[.!?。！？]\s|[。！？]", t[e:a])]
            kind = max(near)[1] if near else None
            if any(k == "" for e, k in near) and not any(k == "phone" and e == max(near)[0] for e, k in near):
                continue
            if near and any(k == "" for _, k in near) and not s.startswith("+"):
                continue
            if kind == "id_number" and not s.startswith("+"):
                taken.append((a, b, "id_number"))
            elif s.startswith("+") or kind == "phone" or STRONG.match(s) and not re.match(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}", s):
                taken.append((a, b, "phone"))
            elif re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}", s):
                taken.append((a, b, "id_number"))
    low = _lower(t)
    parts = names.find(low)
    i = 0
    while i < len(parts):
        a, b = parts[i]
        lead = low[a:b]
        while i + 1 < len(parts) and low[b : parts[i + 1][0]] in ("", " ", " ", "　", "·", "・"):
            i += 1
            b = parts[i][1]
        i += 1
        if x := _INITIAL.search(t[max(0, a - 6) : a]):
            # an initial, unless it is the title "M." before a first name
            if lead not in names.first:
                a = max(0, a - 6) + x.start()
        kind = _script(lead[0])
        if kind == "free" and len(low[a:b].replace(" ", "")) < 4 and not (t[max(0, a - 3) : a] == "คุณ" or t[b : b + 2] in ("さん", "先生", "经理") or len(low[a:b]) >= 3):
            continue
        if free(a, b):
            taken.append((a, b, "name"))
    for x in (*TITLE.finditer(t), *(KIN.finditer(t) if "kin" in may else ())):
        a, b = x.span(1)
        if x.group(1).split()[0].lower() not in _NOT_NAMES and free(a, b):
            taken.append((a, b, "name"))
    if (x := HEAD.match(t)) and free(*x.span(1)) and not any(w.lower() in ("speaker", "them", "note", "step") for w in x.group(1).split()):
        taken.append((*x.span(1), "name"))
    return sorted((*m.span(a, b, text), k) for a, b, k in taken)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders, numbered by distinct value of a type."""
    out, at, seen = [], 0, {}
    for a, b, k in found:
        n = seen.setdefault((k, text[a:b].lower()), 1 + sum(x == k for x, _ in seen))
        out += [text[at:a], f"[{k.upper()}_{n}]"]
        at = b
    return "".join([*out, text[at:]])


def _lower(t: str) -> str:
    """Lower case of the same length."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


#: First characters of words in scripts without word ends (see :func:`_script`).
_LOOSE = re.compile("[\u0530-\u05ff\u0780-\u08ff\u0e00-\U0010ffff]")


def candidates(low: str, bound: list[int], loose: list[int]) -> set[str]:
    """The parts of a lower-case text that :meth:`Names.find` may take for a word of a name.

    ``bound`` are the lengths of words in scripts with word ends, ``loose`` those of the others.
    """
    kinds = [_script(c) for c in low]
    n, out = len(low), set()
    for a, kind in enumerate(kinds):
        fixed = kind in ("cased", "joined")
        if not low[a].isspace() and not (fixed and a and kinds[a - 1] == kind):
            sizes = loose if _LOOSE.match(low[a]) else bound
            out.update(low[a : a + k] for k in sizes if a + k <= n and not (fixed and a + k < n and kinds[a + k] == kind))
    return out


def _looked_up(texts: DataFrame, shown: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``__names``, the words of names in each text, by joins of the texts' own parts with all words of names.

    Words depend on the text alone, so distinct texts are looked up, by two hashes. Rows are (word, kind): a word of a
    name, a first one, a head or a tail of names without spaces (see :func:`name_words`).
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n in b["n"]:
                one, pieces = name_words([n]), unicodedata.normalize("NFC", n).lower().split()
                rows += [(w, "word", None) for w in one.words] + [(w, "first", None) for w in one.first]
                if all(_script(p[0]) == "free" for p in pieces) and len(solid := "".join(pieces)) <= 6:
                    rows += [(solid[:k], "half", solid[k:]) for k in (2, 3) if 0 < len(solid) - k <= 3]
            yield pd.DataFrame(rows, columns=["word", "kind", "tail"])

    distinct = shown.filter(F.trim(F.col(column)) != "").select(F.col(column).alias("n")).distinct()
    known = cut(distinct.mapInPandas(parts, "word string, kind string, tail string").distinct())
    halves = known.filter("kind = 'half'").select("word", "tail")
    many = halves.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    tails = halves.join(many, "word", "left_semi").select("tail").distinct()
    whole = halves.join(tails.withColumn("in", F.lit(1)), "tail", "left").groupBy("word").agg(F.every(F.col("in").isNotNull()).alias("all")).filter("all").select("word")
    heads = many.union(whole).distinct()
    words = cut(known.filter("kind != 'half'").select("word", "kind").unionByName(heads.withColumn("kind", F.lit("head"))).unionByName(tails.select(F.col("tail").alias("word"), F.lit("tail").alias("kind"))))
    # the distinct lengths of words of names; tails are looked for behind heads only
    sizes = {(r.loose, r.n) for r in words.select(F.char_length("word").alias("n"), F.col("word").rlike(f"^{_LOOSE.pattern}").alias("loose")).distinct().collect()}
    lengths = [sorted({n for x, n in sizes if x == loose}) for loose in (False, True)]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, g, w) for h, g, t in zip(b["h"], b["g"], b["__text"]) for w in candidates(_lower(normalise(t)[0].text), *lengths)]
            yield pd.DataFrame(rows, columns=["h", "g", "word"])

    hashed = texts.withColumn("h", F.xxhash64("__text")).withColumn("g", F.hash("__text"))
    own = hashed.select("h", "g", "__text").dropDuplicates(["h", "g"]).mapInPandas(split, "h bigint, g int, word string")
    hits = own.join(words, "word").groupBy("h", "g").agg(F.collect_list(F.struct("word", "kind")).alias("__names"))
    return hashed.join(hits, ["h", "g"], "left").drop("h", "g")


def _with_names(df: DataFrame, keys: dict[str, Column], text: str, shown: DataFrame, column: str, most: int) -> tuple[DataFrame, Callable[[pd.DataFrame], Iterator[tuple[tuple, str, Names]]]]:
    """Keys, ``__text`` and what else tells the names; a function that gives (key, text, names) of a batch's rows."""
    used = list(keys)
    d = df.filter(F.col(text).isNotNull()).select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("__text"))
    rows = shown.filter(F.trim(F.col(column)) != "").select(F.col(column).alias("n")).distinct().limit(most + 1).collect()
    if len(rows) <= most:
        sent = name_words([r.n for r in rows])
        return spread(d), lambda b: ((key, t, sent) for *key, t in b[[*used, "__text"]].itertuples(index=False, name=None))

    def each(b: pd.DataFrame) -> Iterator[tuple[tuple, str, Names]]:
        for *key, t, found in b[[*used, "__text", "__names"]].itertuples(index=False, name=None):
            by: dict[str, set[str]] = {}
            for r in found if found is not None else ():
                by.setdefault(r["kind"], set()).add(r["word"])
            yield key, t, Names(sorted(by.get("word", ())), by.get("first", set()), by.get("head", set()), by.get("tail", set()))

    return _looked_up(d, shown, column), each


def find_pii(df: DataFrame, keys: dict[str, Column], text: str, shown: DataFrame, column: str, most: int = NAMES_SENT) -> DataFrame:
    """The ``keys``, ``pii_type``, ``start_char``, ``end_char`` and ``value`` of every value in every row's text.

    ``column`` of ``shown`` has the known names, any number of them: more than ``most`` distinct ones are joined to the
    texts' words instead of being sent out, with the same result. Null and blank texts give no rows; repeated rows give
    theirs each; null and blank names and other columns are ignored.
    """
    d, each = _with_names(df, keys, text, shown, column, most)
    schema = T.StructType([f for f in d.schema.fields if f.name in keys] + [T.StructField("pii_type", T.StringType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("value", T.StringType())])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*key, k, s, e, t[s:e]) for key, t, names in each(b) for s, e, k in find(t, names)], columns=columns)

    return d.mapInPandas(run, schema)


def redact_pii(df: DataFrame, keys: dict[str, Column], text: str, shown: DataFrame, column: str, most: int = NAMES_SENT) -> DataFrame:
    """The ``keys`` and ``text`` with placeholders such as [EMAIL_1]; null texts stay out, all other rows come out.

    Names are known as in :func:`find_pii`.
    """
    d, each = _with_names(df, keys, text, shown, column, most)
    schema = T.StructType([f for f in d.schema.fields if f.name in keys] + [T.StructField("text", T.StringType())])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*key, redact(t, find(t, names))) for key, t, names in each(b)], columns=columns)

    return d.mapInPandas(run, schema)
