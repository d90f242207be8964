"""Languages of documents and of the stretches of mixed segments, by Bayesian fusion of evidence.

A character n-gram model of the Latin-script languages is trained on all texts, which function words label; other
scripts name their language. A segment's words are decoded into stretches of one language. The stretches' log likelihoods
add up to each document's text evidence by grouped aggregation; declared label, address suffix and a host prior, smoothed
towards that of the host's family and that towards the prior of all documents, join it as log odds.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.llm.pii import _DISGUISED, _lower, signs
from murmura.llm.turns import _CLOCK, _LABEL, NOTES
from murmura.session import cut, spread

LANGS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja", "th", "hi", "ar")
LATIN = LANGS[:5]

# Function words, names of the languages, two-letter address suffixes.
FUNCTION_WORDS = {
    "en": "the and of to is was were that this it we you not are with for on be have has at by from or which if they there will can who he she our but all about please",
    "de": "der die das und ist nicht wir ich ein eine zu den dem des mit für auf von im sich es sie auch noch wenn dass kann wird haben hat bitte aber nach uns",
    "fr": "le la les et est une un des du de dans que qui pas pour nous vous il elle ne sur avec au aux ce cette sont mais on par plus été même si",
    "es": "el la los las y es una un de que en no se por para con del al lo su pero más está como hay nos esto esta hubo le todavía si cuando",
    "pt": "o a os as e é uma um de que em não se por para com do da dos das no na mas mais está são isso nos até também ao pela houve ainda",
}
NAMES = {
    "en": "en eng english englisch anglais inglés inglês английский 英语 英語 อังกฤษ अंग्रेज़ी الإنجليزية",
    "de": "de deu ger german deutsch allemand alemán alemão немецкий 德语 ドイツ語 เยอรมัน जर्मन الألمانية",
    "fr": "fr fra fre french français francais französisch francés francês французский 法语 フランス語 ฝรั่งเศส फ़्रेंच الفرنسية",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol испанский 西班牙语 スペイン語 สเปน स्पेनिश الإسبانية",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués португальский 葡萄牙语 ポルトガル語 โปรตุเกส पुर्तगाली البرتغالية",
    "ru": "ru rus russian русский russisch russe ruso russo 俄语 ロシア語 รัสเซีย रूसी الروسية",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 普通话 chinesisch chinois chino chinês китайский 中国語 จีน चीनी الصينية",
    "ja": "ja jpn jp japanese 日本語 日语 japanisch japonais japonés japonês японский ญี่ปุ่น जापानी اليابانية",
    "th": "th tha thai ไทย ภาษาไทย thailändisch thaï tailandés tailandês тайский 泰语 タイ語 थाई التايلاندية",
    "hi": "hi hin hindi हिन्दी हिंदी хинди 印地语 ヒンディー語 ฮินดี الهندية",
    "ar": "ar ara arabic العربية عربي arabisch arabe árabe арабский 阿拉伯语 アラビア語 อาหรับ अरबी",
}
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "pt": "pt", "br": "pt", "ru": "ru", "cn": "zh", "tw": "zh", "jp": "ja", "th": "th", "in": "hi", "eg": "ar", "sa": "ar"}
_BY_NAME = {w: code for code, ws in NAMES.items() for w in ws.split()}

FEATURES = 1 << 16
#: Roots of counts are summed in this part of one, so that no sum depends on its order.
UNIT = 1 << 20
#: Evidence of one word is at most this many nats; a change of language costs these, inside a clause and at its end.
WORD_MOST, SWITCH, SWITCH_AT_END = 3.0, 9.0, 5.0
_WORD = re.compile(r"(?:[^\W\d_]|[̀-ͯऀ-ॣ०-෿฀-๿])+(?:['’-](?:[^\W\d_]|[̀-ͯ])+)*")
_SKIP = re.compile(
    rf"(?<!\S)\S+@\S+|https?://\S+|[<\[(]?{_CLOCK}[>\])]?(?:\s*-->\s*{_CLOCK})?|(?<![^\W_])(?!\s)(?:\*\*|<b>|[\[(])?{_LABEL}\s*(?:[:：]|\*\*|</b>|[\])]|>|\s-\s)|</?b>"
    r"|\[\[?[^\[\]\n]{1,40}\]\]?|\{[^{}\n]{1,40}\}|♪[^♪\n]*♪|<[^<>\n]{1,30}>|\*[^*\n]{1,24}\*|(?<![^\W_])(?:(?:me|them|note|step \d+|agenda|question):)|(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{40,}",
    re.I,
)
#: A document's text speaks with this many nats at most; a piece of it, after tempering (its words are no independent ones), likewise.
DOC_MOST, PIECE_MOST, TEMPER = 20.0, 2.0, 6.0
#: Letters of Thai, and characters of Chinese and Japanese, that count as a word.
LETTERS = 3
#: Share of kana among the characters of Japanese and of Chinese texts.
KANA = (0.5, 0.005)
#: Signs without which nothing is skipped.
_MAY_SKIP = re.compile(r"[\[\]{}<>()（）*♪@:：=]|\s-\s|https?|\dh\d|[A-Za-z0-9+/=_-]{40}")
_ROUND = re.compile(r"[(（]([^()（）\n]{1,34})[)）]")
#: Least words (letters in scripts without spaces) of a stretch that holds a whole sentence.
LEAST = {"zh": 6, "ja": 8, "th": 12}
LEAST_WORDS = 4


def code_of(label: str | None) -> str | None:
    """The code that a label names: a code of two or three letters with or without region, or a language's name."""
    if not label:
        return None
    s = unicodedata.normalize("NFC", label).strip().lower()
    if s in _BY_NAME:
        return _BY_NAME[s]
    return _BY_NAME.get(re.split(r"[-_ (]", s, maxsplit=1)[0])


def code_column(c: Column) -> Column:
    """:func:`code_of` as a column expression."""
    s = F.lower(F.trim(F.regexp_replace(c, r"[\s\x{a0}\x{3000}]+", " ")))
    table = F.create_map(*[F.lit(x) for kv in _BY_NAME.items() for x in kv])
    return F.coalesce(table[s], table[F.regexp_extract(s, r"^([^-_ (]+)", 1)])


def _grams(word: str) -> list[int]:
    w = f"^{word.lower()}$"
    out = [zlib.crc32(b"w" + w.encode())]
    for k in (1, 2, 3, 4):
        out += [zlib.crc32(bytes([k]) + w[i : i + k].encode()) for i in range(len(w) - k + 1)]
    return [g % FEATURES for g in out]


#: What may hold a word in Latin script, once in lower case.
_MAY_LATIN = r"[A-Za-z\x{aa}-\x{24f}\x{1e9e}\x{212a}\x{212b}\x{2c7e}\x{2c7f}]"
_CLAUSE_END = re.compile(r"[.!?。！？।؟\n—]")
#: Function words of one language only, by the language's number.
_CUES = {w: i for i, c in enumerate(LATIN) for w in FUNCTION_WORDS[c].split() if sum(w in v.split() for v in FUNCTION_WORDS.values()) == 1}
#: (language's number, function word): each is counted once before any text.
_SEEDS = [(i, w) for i, c in enumerate(LATIN) for w in dict.fromkeys(FUNCTION_WORDS[c].split())]
#: Words of a clause that the model labels, at least, and the nats by which its language leads.
CLAUSE_WORDS, LEAD = 3, 3.0


def clauses(text: str) -> list[list[str]]:
    """The words in Latin script of each clause of a text, in lower case."""
    t = _SKIP.sub(" ", text) if _MAY_SKIP.search(text) else text
    return [[w for w in _WORD.findall(p.lower()) if ord(w[0]) < 0x250] for p in _CLAUSE_END.split(t)]


def by_function_words(cuts: list[list[str]]) -> int:
    """The number of the language that the function words of a whole text name; -1 where they name none."""
    votes = np.bincount([_CUES[w] for p in cuts for w in p if w in _CUES], minlength=len(LATIN))
    top = np.sort(votes)
    return int(votes.argmax()) if top[-1] >= 2 and top[-1] > 4 * top[-2] else -1


def gram_counts(langs: list[int], words: list[str], counts: list[int]) -> np.ndarray:
    """(languages, FEATURES): sums of the words' root counts, in ``UNIT``, so that frequent templates weigh less."""
    out = np.zeros((len(LATIN), FEATURES), np.int64)
    if words:
        grams = [_grams(w) for w in words]
        sizes = [len(g) for g in grams]
        roots = np.rint(np.sqrt(np.asarray(counts, np.float64)) * UNIT).astype(np.int64)
        np.add.at(out, (np.repeat(langs, sizes), np.concatenate(grams)), np.repeat(roots, sizes))
    return out


class Model:
    """Naive Bayes of hashed n-grams for the languages in Latin script; scores of words are remembered.

    Of ``texts`` at hand; :func:`train` gives the same model of a table's texts.
    """

    def __init__(self, texts: list[str]):
        first, second, parts = Counter(_SEEDS), Counter(_SEEDS), Counter()
        for t in texts:  # function words of the whole text label its clauses in the first round
            cuts = clauses(t)
            parts.update(tuple(p) for p in cuts if len(p) >= CLAUSE_WORDS)
            if (i := by_function_words(cuts)) >= 0:
                first.update((i, w) for p in cuts for w in p)
        self.learn(self._grams_of(first))
        for (p, n), i in zip(parts.items(), self.own([*parts])):  # the model itself labels the second
            if i >= 0:
                second.update(dict.fromkeys([(i, w) for w in p], n))
        self.learn(self._grams_of(second))

    @staticmethod
    def _grams_of(words: Counter) -> np.ndarray:
        return gram_counts([i for i, _ in words], [w for _, w in words], [*words.values()])

    def learn(self, grams: np.ndarray) -> "Model":
        """The model of :func:`gram_counts`."""
        count = grams / UNIT + 1e-3
        # relative to the same gram in the other languages, so that the languages' amounts of text do not matter
        share = count / count.sum(1, keepdims=True)
        self.log = np.log((share + 2e-6) / (share.sum(0, keepdims=True) + 2e-6 * len(LATIN))).astype(np.float32)
        self.words: dict[str, np.ndarray] = {}
        return self

    def own(self, cuts: list) -> list[int]:
        """The number of each clause's language, -1 where none leads; no clause is empty."""
        if not cuts:
            return []
        index: dict[str, int] = {}
        ids = [index.setdefault(w, len(index)) for p in cuts for w in p]
        scores = np.stack([self.word(w) for w in index]).astype(np.float64)[ids]
        sizes = np.array([len(p) for p in cuts])
        total = np.add.reduceat(scores, np.cumsum(sizes) - sizes, 0)
        top = np.sort(total, 1)
        return np.where(top[:, -1] - top[:, -2] >= LEAD, total.argmax(1), -1).tolist()

    def word(self, w: str) -> np.ndarray:
        """Log likelihoods of a lower-case word, less the best, at least -WORD_MOST."""
        s = self.words.get(w)
        if s is None:
            if len(self.words) > 200_000:
                self.words.clear()
            g = self.log[:, _grams(w)]
            s = g.mean(1) * 2 + g[:, 0]  # the whole word counts beside its parts
            s = np.maximum(s - s.max(), -WORD_MOST)
            self.words[w] = s
        return s


def _script(w: str) -> str:
    """'latin', a language that its script names, 'han' or 'kana', or '' for other scripts."""
    o = ord(w[0])
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    for lo, hi, s in ((0x400, 0x530, "ru"), (0x600, 0x780, "ar"), (0x900, 0x980, "hi"), (0xE00, 0xE80, "th"), (0x3040, 0x3100, "kana"), (0x3100, 0xA000, "han"), (0xF900, 0xFB00, "han")):
        if lo <= o < hi:
            return s
    return ""


_RUN = re.compile(r"[ऀ-ॿ]+|[฀-๿]+|[぀-ヿー]+|[㐀-鿿々]+|[؀-ݿ]+|[Ѐ-ԯ]+|(?:[^\W\d_]|[̀-ͯ'’-])+")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _note(m: re.Match) -> str:
    inner = m.group(1).lower()
    return _blank(m) if any(n in inner for n in NOTES) else m.group()


_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Letters that are words.
_LETTER_WORDS = frozenset("aeoàéyiuAEOÀÉYIU")
#: A letter of another script than Latin, or a mark on one.
_BEYOND = re.compile(r"[^\x00-\u024f\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff]")


#: (language, start, end, words or letters, confidence, log likelihoods by LANGS relative to the best) of a stretch.
Stretch = tuple[str, int, int, int, float, np.ndarray]


def _of_script(lang: str, a: int, b: int, size: int, words: float, kana: int | None = None) -> Stretch:
    """A stretch of a script that names its language: each word speaks against the others as strongly as a word can."""
    nats = np.full(len(LANGS), -WORD_MOST * max(words, 1.0))
    if kana is not None:  # Chinese or Japanese: by the share of kana
        ja = kana * np.log(KANA[0] / KANA[1]) + (size - kana) * np.log((1 - KANA[0]) / (1 - KANA[1]))
        nats[[LANGS.index("zh"), LANGS.index("ja")]] = min(0.0, -ja), min(0.0, ja)
    nats[LANGS.index(lang)] = 0.0
    p = np.exp(nats)
    return lang, a, b, size, float(p[LANGS.index(lang)] / p.sum()), nats


def stretches(text: str, model: Model) -> list[Stretch]:
    """The stretches of one language in a text, in order."""
    return stretches_of([text], model)[0]


def stretches_of(texts: list[str], model: Model) -> list[list[Stretch]]:
    """:func:`stretches` of every text; the words of all texts in Latin script are scored as one matrix."""
    runs: list[tuple[str, list[tuple[int, int, str]]]] = []
    found: list[list] = []
    for text in texts:
        t = _DISGUISED.sub(_blank, text) if "at" in signs(_lower(text))[0] else text
        if _MAY_SKIP.search(t):
            t = _ROUND.sub(_note, _SKIP.sub(_blank, t))
        if not _BEYOND.search(t):  # Latin script only: one run
            words = [(a, b, w) for a, b, w in ((*m.span(), m.group()) for m in _LATIN_WORD.finditer(t)) if b - a > 1 or w in _LETTER_WORDS]
            if words:
                runs.append((t, words))
            found.append([len(runs) - 1] if words else [])
            continue
        words = []
        for m in _WORD.finditer(t):
            w, a, b = m.group(), m.start(), m.end()
            if b - a == 1 and ord(w) < 0x250 and w not in _LETTER_WORDS:
                continue
            if ord(w[0]) < 0x250 and ord(w[-1]) < 0x250:
                words.append((a, b, w))
            else:
                words += [(a + r.start(), a + r.end(), r.group()) for r in _RUN.finditer(w)]
        units: list = []
        kinds = [_script(w[2]) for w in words]
        i = 0
        while i < len(words):
            kind, j = kinds[i], i
            if kind == "latin":
                while j < len(words) and kinds[j] == "latin":
                    j += 1
                units.append(len(runs))
                runs.append((t, words[i:j]))
            elif kind in ("han", "kana"):
                kana = 0
                while j < len(words) and kinds[j] in ("han", "kana") and not (j > i and _turn(t, words[j - 1], words[j])):
                    kana += (words[j][1] - words[j][0]) * (kinds[j] == "kana")
                    j += 1
                size = sum(b - a for a, b, _ in words[i:j])
                units.append(_of_script("ja" if kana >= 0.12 * size else "zh", words[i][0], words[j - 1][1], size, size / LETTERS, kana))
            else:
                while j < len(words) and kinds[j] == kind:
                    j += 1
                if kind:
                    size = sum(b - a for a, b, _ in words[i:j]) if kind == "th" else j - i
                    units.append(_of_script(kind, words[i][0], words[j - 1][1], size, size / LETTERS if kind == "th" else size))
            i = max(j, i + 1)
        found.append(units)
    latin = _latin(runs, model)
    out: list[list[Stretch]] = []
    for units in found:
        merged: list[Stretch] = []
        for u in (x for u in units for x in (latin[u] if isinstance(u, int) else (u,))):
            if merged and merged[-1][0] == u[0]:
                p = merged[-1]
                merged[-1] = (u[0], p[1], u[2], p[3] + u[3], max(p[4], u[4]), p[5] + u[5])
            else:
                merged.append(u)
        out.append(merged)
    return out


def _turn(t: str, a: tuple, b: tuple) -> bool:
    """A sentence ends between two words."""
    return bool(re.search(r"[。！？.!?—,，\n]\s*$|[。！？.!?]", t[a[1] : b[0]])) and _script(b[2]) != _script(a[2]) and " " in t[a[1] : b[0]]


def _latin(runs: list[tuple[str, list[tuple[int, int, str]]]], model: Model) -> list[list[Stretch]]:
    """Stretches of each run of words in Latin script of its text."""
    if not runs:
        return []
    index: dict[str, int] = {}
    ids = [index.setdefault(w[2].lower(), len(index)) for _, words in runs for w in words]
    scores = np.stack([model.word(w) for w in index])[ids]
    sizes = np.array([len(words) for _, words in runs])
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(scores, starts, 0)
    best = total.argmax(1)
    gain = scores - scores[np.arange(len(scores)), np.repeat(best, sizes)][:, None]
    # a run changes its language only where another one gains more than a change costs
    may_change = np.add.reduceat(np.maximum(gain, 0), starts, 0).max(1) > SWITCH_AT_END
    out = []
    for r, (t, words) in enumerate(runs):
        a, n = starts[r], sizes[r]
        if may_change[r]:
            path = _path(t, words, scores[a : a + n], int(best[r]))
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1), n]
            parts = [(x, y, int(path[x]), scores[a + x : a + y].sum(0)) for x, y in zip(edges, edges[1:])]
        else:
            parts = [(0, n, int(best[r]), total[r])]
        found = []
        for x, y, k, e in parts:
            e = e - e.max()
            p = np.exp(e)
            nats = np.full(len(LANGS), -WORD_MOST * float(y - x))
            nats[: len(LATIN)] = e
            found.append((LATIN[k], words[x][0], words[y - 1][1], int(y - x), float(p[k] / p.sum()), nats))
        out.append(found)
    return out


def _path(t: str, words: list[tuple[int, int, str]], s: np.ndarray, best: int) -> np.ndarray:
    """The language of each word: one for all unless changes gain more than they cost (Viterbi)."""
    path = np.full(len(words), best)
    c = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s - s[:, [best]], 0)])
    if (c - np.minimum.accumulate(c, 0)).max() > SWITCH_AT_END:
        cost = np.array([0.0] + [SWITCH_AT_END if re.search(r"[.!?…—\n]|\s-\s", t[a[1] : b[0]]) else SWITCH_AT_END + 2 if "," in t[a[1] : b[0]] else SWITCH for a, b in zip(words, words[1:])])
        score, back = s[0].copy(), np.zeros(s.shape, np.int64)
        for i in range(1, len(words)):
            top = int(score.argmax())
            change = score[top] - cost[i]
            back[i] = np.where(score >= change, np.arange(s.shape[1]), top)
            score = np.maximum(score, change) + s[i]
        k = int(score.argmax())
        for i in range(len(words) - 1, -1, -1):
            path[i] = k
            k = int(back[i, k])
    return path


def whole(found: list[Stretch]) -> list[Stretch]:
    """The stretches that are long enough for a sentence."""
    return [u for u in found if u[3] >= LEAST.get(u[0], LEAST_WORDS) and (u[0] not in LATIN or u[4] > 0.8)]


def train(rows: DataFrame, text: str) -> Model:
    """``Model`` of every text of ``rows``, counted where the texts are.

    Each text is cut once into clauses, of which distinct ones are kept with their numbers; both rounds sum words of these,
    and roots of the words' sums by n-gram. To the driver come these last sums only, one row an n-gram (``FEATURES`` at most).
    """
    spark = rows.sparkSession
    d = spread(rows.filter(F.col(text).rlike(_MAY_LATIN)).select(F.col(text).alias("t")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for t, n in Counter(b["t"]).items():
                cuts = clauses(t)
                lang = by_function_words(cuts)
                for p in cuts:
                    if len(p) >= CLAUSE_WORDS or (p and lang >= 0):
                        found[lang, " ".join(p)] += n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "clause", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(LATIN), FEATURES), np.int64)
        for b in batches:
            out += gram_counts(b["lang"].tolist(), b["w"].tolist(), b["n"].tolist())
        used = np.flatnonzero(out.any(0))
        yield pd.DataFrame({"gram": used} | {c: out[i, used] for i, c in enumerate(LATIN)})

    def learnt(words: DataFrame) -> Model:
        seeds = spark.createDataFrame([(i, w, 1) for i, w in _SEEDS], "lang int, w string, n long")
        sums = words.unionByName(seeds).groupBy("lang", "w").agg(F.sum("n").alias("n"))
        grams = sums.mapInPandas(count, ", ".join(f"{c} long" for c in ("gram", *LATIN))).groupBy("gram").agg(*[F.sum(c).alias(c) for c in LATIN]).toArrow()
        out = np.zeros((len(LATIN), FEATURES), np.int64)
        for i, c in enumerate(LATIN):
            out[i, grams["gram"].to_numpy()] = grams[c].to_numpy()
        return Model([]).learn(out)

    cuts = cut(d.mapInPandas(split, "lang int, clause string, n long").groupBy("lang", "clause").agg(F.sum("n").alias("n")))
    words = F.split("clause", " ")
    first = learnt(cuts.filter("lang >= 0").select("lang", F.explode(words).alias("w"), "n"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(lang=first.own([p.split(" ") for p in b["clause"]]))

    own = spread(cuts.filter(F.size(words) >= CLAUSE_WORDS)).mapInPandas(label, cuts.schema).filter("lang >= 0")
    return learnt(own.select("lang", F.explode(F.array_distinct(words)).alias("w"), "n"))


def evidence(found: list[Stretch], good: list[Stretch]) -> list[float] | None:
    """Log likelihoods of a text by LANGS, at most ``PIECE_MOST``: of its sentences, tempered; None without one."""
    if not good:
        return None
    nats = np.sum([u[5] for u in good], 0) / TEMPER
    return np.maximum(nats - nats.max(), -PIECE_MOST).tolist()


def language_stretches(df: DataFrame, keys: dict[str, Column], text: str, model: Model) -> DataFrame:
    """The ``keys``, ``lang``, ``start_char``, ``end_char``, ``size``, ``confidence``, ``sentence`` (long enough for one) and ``nats``.

    ``nats`` has the whole text's :func:`evidence`, in the row of its first stretch only, so that sums over rows count it
    once. Texts without letters, null and blank ones give no rows; repeated rows give theirs each; other columns are
    ignored. Distinct texts of a batch are decoded once.
    """
    d = spread(df.filter(F.col(text).rlike(r"\S")).select(*[c.alias(n) for n, c in keys.items()], F.col(text).alias("__text")))
    schema = T.StructType(
        [f for f in d.schema.fields if f.name != "__text"]
        + [T.StructField(n, t) for n, t in (("lang", T.StringType()), ("start_char", T.LongType()), ("end_char", T.LongType()), ("size", T.LongType()), ("confidence", T.DoubleType()), ("sentence", T.BooleanType()), ("nats", T.ArrayType(T.DoubleType())))]
    )
    columns, used = [f.name for f in schema.fields], [*keys, "__text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(dict.fromkeys(b["__text"]))
            rows_of = {}
            for t, found in zip(texts, stretches_of(texts, model)):
                good = whole(found)
                spans = {u[1] for u in good}
                nats = evidence(found, good)
                rows_of[t] = [(*u[:5], u[1] in spans, None if i else nats) for i, u in enumerate(found)]
            yield pd.DataFrame([(*key, *r) for *key, t in b[used].itertuples(index=False, name=None) for r in rows_of[t]], columns=columns)

    return d.mapInPandas(run, schema)


def mixed(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of the ``keys`` and language: the longest stretch, of rows that hold sentences of two languages or more."""
    each = found.filter("sentence").groupBy(*keys, "lang").agg(F.max("size").alias("size"), F.max("confidence").alias("confidence"))
    return each.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter("n > 1").drop("n")


def fuse(pieces: DataFrame, docs: DataFrame, key: str, declared: str | None = None, suffix: str | None = None, host: str | None = None, strength: float = 8.0, salts: int = 16) -> DataFrame:
    """(key, lang, confidence, declared_code) of every row of ``docs``.

    ``pieces`` (key, nats) are log likelihoods of pieces of the documents by LANGS, none above 0 (:func:`evidence`); a
    document's sum, less its best, counts down to ``-DOC_MOST``. The declared label's weight is the log odds of its
    measured agreement with the texts, an address suffix's likewise. The prior is that of the host, smoothed with
    ``strength`` documents towards that of the host's family (its first word), and this one likewise towards that of all.
    Without any evidence the prior decides. One row per row of ``docs``; null evidence is none; ties go to the first code
    in alphabetical order. Hosts are salted, so that one of a third of all documents is no task of its own.
    """
    label = code_column(F.col(declared)) if declared else F.lit(None).cast("string")
    tail = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.lower(F.col(suffix))] if suffix else F.lit(None).cast("string")
    d = docs.select(F.col(key).alias("k"), label.alias("declared_code"), tail.alias("by_suffix"), (F.col(host).cast("string") if host else F.lit(None).cast("string")).alias("host"))
    d = d.withColumn("host", F.when(F.trim("host") != "", F.col("host")))
    sums = pieces.filter(F.col("nats").isNotNull()).groupBy(F.col(key).alias("k")).agg(*[F.sum(F.col("nats")[i]).alias(c) for i, c in enumerate(LANGS)])
    best = F.greatest(*LANGS)
    first = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in sorted(LANGS)])
    by = sums.select("k", first.alias("top"), F.array(*[F.greatest(F.col(c) - best, F.lit(-DOC_MOST)) for c in LANGS]).alias("text"))
    d = cut(d.join(by, "k", "left"))
    seen = d.filter("top IS NOT NULL")
    # agreement of label and suffix with the texts, over all documents, smoothed
    r = seen.agg(*[F.expr(f"(count_if({c} = top) + 8) / (count_if({c} IS NOT NULL) + 10)").alias(c) for c in ("declared_code", "by_suffix")]).first()
    w_label, w_suffix = (float(np.log(r[c] / (1 - r[c]) * (len(LANGS) - 1))) for c in ("declared_code", "by_suffix"))
    counted = {x.top: x["count"] for x in seen.groupBy("top").count().collect()}
    prior = [(counted.get(c, 0) + 1) / (sum(counted.values()) + len(LANGS)) for c in LANGS]
    # counts by host and by family: one row each
    family = F.split("host", r"[\s:/_.-]")[0]
    of = lambda c: F.count_if(F.col("top") == c)
    hosts = seen.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.array(*[of(c) for c in LANGS]).alias("by"))
    families = hosts.groupBy(family.alias("family")).agg(F.sum("n").alias("m"), F.array(*[F.sum(F.col("by")[i]) for i in range(len(LANGS))]).alias("in_family"))
    smooth = lambda by, n, towards: F.array(*[(F.col(by)[i] + strength * towards(i)) / (F.col(n) + strength) for i in range(len(LANGS))])
    families = families.select("family", smooth("in_family", "m", lambda i: F.lit(prior[i])).alias("over"))
    hosts = hosts.withColumn("family", family).join(families, "family").select("host", smooth("by", "n", lambda i: F.col("over")[i]).alias("prior"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = d.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int")).join(hosts, ["host", "salt"], "left")
    score = lambda i, c: (
        F.log(F.coalesce(F.col("prior")[i], F.lit(prior[i])))
        + F.coalesce(F.col("text")[i], F.lit(0.0))
        + F.when(F.col("declared_code") == c, w_label).otherwise(0.0)
        + F.when(F.col("by_suffix") == c, w_suffix).otherwise(0.0)
    )
    d = d.withColumn("scores", F.array(*[F.struct(score(i, c).alias("s"), F.lit(c).alias("lang")) for i, c in enumerate(LANGS)]))
    d = d.withColumn("best", F.array_max(F.transform("scores", lambda x: x.s)))
    d = d.withColumn("lang", F.element_at(F.sort_array(F.transform(F.filter("scores", lambda x: x.s == F.col("best")), lambda x: x.lang)), 1))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x.s - F.col("best")))
    return d.select(F.col("k").alias(key), "lang", (1 / total).alias("confidence"), "declared_code")


def address_suffixes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, suffix): the commonest suffix that names a language among the mail and web addresses in each key's texts; ties go to the first."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?i)(?:@|https?://|www\.)[\w-]+(?:\.[\w-]+)*\.([a-z]{2})(?![\w.-])"), F.lit(1))
    each = texts.filter(F.col(text).contains("@") | F.col(text).contains("://") | F.lower(text).contains("www.")).select(F.col(key).alias("k"), F.explode(found).alias("s")).withColumn("s", F.lower("s"))
    each = each.filter(F.col("s").isin([*SUFFIXES])).groupBy("k", "s").agg(F.count("*").alias("n"))
    return each.groupBy("k").agg(F.min(F.struct(-F.col("n"), "s")).alias("x")).select(F.col("k").alias(key), F.col("x.s").alias("suffix"))
