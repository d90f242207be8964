"""Transcript segments into clean speaker turns.

Tokens of a segment are tagged speaker, timestamp, annotation, filler or speech by a hidden Markov model, which observes
their form, shape, place and neighbours beside word lists, and decoded by Viterbi in padded numpy batches; the tags give
the spoken text and the label. Turns are runs of equal (source, speaker)
per meeting. Runs are found within (meeting, hour) first and joined across hours on one summary row each, so that no
task holds a whole meeting.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmura.session import cut, spread

TAGS = ("speaker", "time", "annotation", "filler", "speech")
SPEAKER, TIME, NOTE, FILLER, SPEECH = range(5)

# Words for a speaker, numbers in words, filler sounds, words of sound notes, heads that name nobody.
ROLE = "speaker spk sprecher sprecherin hablante locuteur locutrice orador oradora спикер говорящий 发言人 说话人 話者 発言者 ผู้พูด वक्ता المتحدث المتكلم".split()
NUMBERS = (
    "one eins ein uno un один 一 หนึ่ง एक واحد,two zwei dos deux dois два 二 สอง दो اثنان,three drei tres trois três три 三 สาม तीन ثلاثة,"
    "four vier cuatro quatre quatro четыре 四 สี่ चार أربعة,five fünf cinco cinq пять 五 ห้า पाँच خمسة,six sechs seis шесть 六 หก छह ستة,"
    "seven sieben siete sept sete семь 七 เจ็ด सात سبعة,eight acht ocho huit oito восемь 八 แปด आठ ثمانية,nine neun nueve neuf nove девять 九 เก้า नौ تسعة,"
    "ten zehn diez dix dez десять 十 สิบ दस عشرة"
)
NUMBER = {w: i + 1 for i, ws in enumerate(NUMBERS.split(",")) for w in ws.split()}
FILLERS = frozenset(
    "um uh erm er hmm hm hmmm mm mhm mmm uhm ah eh em este äh ähm öhm ehm euh heu hum ben éé ahn é эм э-э э ммм мм ээ 嗯 呃 额 啊 唔 えっと えーと ええと あの あのー えー うーん อืม เอ่อ อ้า उम्म उम्‌ हम्म अ आ अं उह म्म آه إمم اه امم يعني".split()
)
NOTES = (
    "noise music laughs laughter laughing applause door slams phone rings coughing coughs cough crosstalk blank_audio inaudible unintelligible silence sighs static beep speaking in foreign language "
    "musik applaus gelächter hustet lacht unverständlich musique rires applaudissements toux música risas aplausos risos tosse музыка смех аплодисменты 掌声 笑声 音乐 拍手 笑い 音楽 "
    "ดนตรี เสียงหัวเราะ เสียงปรบมือ संगीत हँसी तालियाँ ضحك موسيقى تصفيق"
).split()
#: Filler sounds that are words of a language: by cue words of that language they are read as words.
AMBIGUOUS = {"um": "pt de", "em": "pt", "é": "pt", "este": "es", "er": "de", "ah": "", "e": "pt", "eh": "", "ben": "", "э": ""}
CUES = {"pt": r"\b(?:não|que|da|do|para|uma|com|está|os|as)\b", "de": r"\b(?:der|die|das|und|nicht|wir|ich|den|ist)\b", "es": r"\b(?:el|los|las|que|para|del|una|está)\b"}
NOBODY = frozenset("note step agenda question answer action todo topic summary re subject warning hinweis frage schritt nota pregunta paso étape remarque passo pergunta".split())

_ROLE = "|".join(sorted(map(re.escape, ROLE), key=len, reverse=True))
_NUM = r"\d{1,4}|" + "|".join(sorted(map(re.escape, NUMBER), key=len, reverse=True))
_CLOCK = r"(?:\d{1,6}(?::\d{2}){1,2}(?:[.,]\d{1,3})?|\d{1,2}h\d{1,2}m\d{1,2}s)"
#: A displayed label ('Speaker 2', 'Speaker #2', 'Sprecher two', 'S2'), or a machine label ('SPEAKER_00').
_LABEL = rf"(?:them|me|you)?\s*\(?\s*(?:(?:{_ROLE})(?:_\d{{1,4}}|\s*\#?\s*(?:{_NUM}))|[sS]\d{{1,3}})\s*\)?"
_OPEN, _CLOSE = r"[\[(<{（【［〔「*]", r"[\])>}）】］〕」*]"

#: A character of a word; \\w has no vowel signs.
_W = r"(?:[^\W_]|[\u0300-\u036f\u0900-\u0963\u0966-\u0dff\u0e00-\u0eff])"

_GAP = r"['’\-]"
#: A sound without being in the list: one or two letters of which one is drawn out, or a short word without vowels.
_SOUND = r"(?=\w{0,9}(?P<drawn>\w)(?P=drawn){2})(?:[hmn]*(?P<vowel>[aeiouäöüаеиоуэя])(?P=vowel)*[hmrnхм]*|[hmnмхн]+)|h+m+|m+h+m*|pf+|ps+t|t+s+k+"
_CJK_SOUND = "嗯+|呃+|额+|唔+|えっと|えーと|ええと|あのー+|うー+ん"
_LISTED = "|".join(sorted((re.escape(f) for f in FILLERS), key=len, reverse=True))
#: What is not plain words: clock, label with its mark, sung line, bracketed group, markup, head in words with a colon, sound.
TOKEN = re.compile(
    rf"""(?P<clock>[\[(<（【]?\s*(?<![^\W_]){_CLOCK}(?:\s*-->\s*{_CLOCK})?\s*[\])>）】]?)
    |(?P<label>(?:\*\*|<b>|[\[(（【])?\s*(?<![^\W_]){_LABEL}\s*(?:[:：]\s*\*\*|\*\*\s*[:：]|</b>\s*[:：]|[\])）】]\s*[:：]?|[:：]|>|\s-(?=\s|$)))
    |(?P<sung>♪[^♪\n]*+♪)
    |(?P<group>\[\[[^\[\]\n]+\]\]|\[[^\[\]\n]+\]|\([^()\n]+\)|（[^（）\n]+）|【[^【】\n]+】|［[^［］\n]+］|\{{[^{{}}\n]+\}}|<[^<>/\n]{{2,}}>|(?<![\w*])\*[^*\n]+\*(?!\*))
    |(?P<self>(?:\*\*)?(?<![^\W_])(?:me|them|you)\s*[:：](?:\*\*)?)
    |(?P<head>(?:\*\*|<b>)[^:：<*\n]+(?:[:：]\s*\*\*|</b>\s*[:：]|\*\*\s*[:：]))
    |(?P<sound>(?:(?<!{_W})(?<!{_W}{_GAP})(?:(?P<listed>{_LISTED})|{_SOUND})(?!{_W})(?!{_GAP}{_W})|(?P<cjk>{_CJK_SOUND}))[.,…，、。]*)""",
    re.X | re.I,
)
#: A plain head such as "Perrin Vandorne:", tried at a text's head only.
HEAD = re.compile(r"\s*([^\W\d_][\w'’.\-]*(?:[  ][^\W\d_][\w'’.\-]*){0,3})\s*[:：](?!\d)")
_LEAD = re.compile(r"[>\-–—•*]")
_LEADS = re.compile(r"(?:\s*[>\-–—•*])+\s*")
_AFTER = re.compile(r"[.,!?;…，、。！？]*")
_WORDS = re.compile(rf"{_W}+")

# Forms of tokens; "run" is everything between the others.
FORMS = ("clock_group", "clock", "label", "sung", "group", "self", "head_mark", "head_word", "sound", "lead", "run", "markup")
CLOCK_GROUP, CLOCK, LABEL, SUNG, GROUP, SELF, HEAD_MARK, HEAD_WORD, SOUND, LEAD, RUN, MARKUP = range(len(FORMS))
#: A token's observation: form, what word lists say, kind of brackets or marks, case, number of words or length, place in the text, next character, last letters.
Observation = tuple[int, str, str, str, int, str, str, str]


def fold(name: str) -> str:
    """A name without white space, in lower case (for matching names)."""
    return "".join(unicodedata.normalize("NFC", name).lower().split())


def _case(s: str) -> str:
    letters = [c for c in s if c.isalpha()]
    if not letters or letters[0].lower() == letters[0].upper():
        return "none"
    return "lower" if letters[0].islower() else "upper" if len(letters) > 1 and all(c.isupper() for c in letters) else "title"


def _inside(inner: str) -> str:
    """What the word lists say of a bracketed group: a sound note, fillers, part of an address, or nothing."""
    low = inner.lower()
    words = re.findall(rf"(?:(?!\d){_W}|_)+", low)
    if any(w in NOTES or w.strip("_") in NOTES for w in words) or any(len(n) > 1 and n in low for n in NOTES if ord(n[0]) > 0x24F):
        return "note"
    if low in ("at", "dot", "draft", "punkt", "punto", "arroba"):
        return "mail"
    return "filler" if words and all(w in FILLERS for w in words) else ""


def _ambiguous(text: str, word: str, end: int) -> bool:
    """A filler sound may be a word of the text's language, unless a pause is written after it."""
    langs = AMBIGUOUS.get(word)
    return bool(langs) and text[end : end + 1] not in (",", "…", ".", "，", "") and any(re.search(CUES[x], text, re.I) for x in langs.split())


_CLOCK_AT = re.compile(r"(?<!\d)\d{1,6}(?=:\d\d|h\d)")
_SHORT_AT = re.compile(r"[sS](?<![^\W_][sS])\d")
_DRAWN_AT = re.compile(r"([^\W\d_])\1\1")
_SIGNS: list = []


def _sign_words():
    """An automaton of what tokens begin with, and what must hold there: 0 nothing, 1 a word's start, 2 a whole word, 3 a colon or bracket behind."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    kinds = dict.fromkeys("[(<{（【［*♪", 0) | dict.fromkeys(("me", "them", "you"), 3) | {f.lower(): 2 for f in FILLERS}
    kinds |= dict.fromkeys(("嗯", "呃", "额", "唔", "えっ", "えー", "ええ", "あの", "うー"), 0) | dict.fromkeys(("hm", "mh", "pf", "ps", "ts"), 1) | dict.fromkeys(ROLE, 1)
    for w, kind in kinds.items():
        auto.add_word(w, (len(w), kind))
    auto.make_automaton()
    return auto


def _part(c: str) -> bool:
    """A character of a word (see _W)."""
    return c.isalnum() or "\u0300" <= c <= "\u036f" or "\u0900" <= c <= "\u0dff" or "\u0e00" <= c <= "\u0eff"


def _places(text: str) -> list[int]:
    """Where tokens other than plain words may begin, in order; TOKEN decides."""
    if not _SIGNS:
        _SIGNS.append(_sign_words())
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    n, out = len(low), set()
    for end, (size, kind) in _SIGNS[0].iter(low):
        a, b = end - size + 1, end + 1
        if kind and a and _part(low[a - 1]) or kind == 2 and b < n and _part(low[b]) or kind == 3 and low[b : b + 2].lstrip()[:1] not in (":", "：", "("):
            continue
        out.add(a)
    out.update(m.start() for m in _CLOCK_AT.finditer(low))
    out.update(m.start() for m in _SHORT_AT.finditer(low))
    word = 0  # end of the last word looked at: each is walked through once
    for m in _DRAWN_AT.finditer(low):
        if m.start() < word:
            continue
        a, word = m.start(), m.end()
        while a and _part(low[a - 1]):
            a -= 1
        while word < n and _part(low[word]):
            word += 1
        out.add(a)
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int, Observation]]:
    """Tokens (start, end, observation) of a text, without the white space between them; every text that has more than that has one."""
    found: list[tuple[int, int, int, str, str]] = []
    at, n, lead = 0, len(text), True
    places = _places(text)
    next_place = 0

    def search(at: int) -> re.Match | None:
        nonlocal next_place
        while next_place < len(places):
            if places[next_place] >= at and (m := TOKEN.match(text, places[next_place])):
                return m
            next_place += 1
        return None

    def run(a: int, b: int) -> None:
        nonlocal lead
        while a < b and text[a].isspace():
            a += 1
        while lead and a < b and _LEAD.match(text, a):
            found.append((a, a + 1, LEAD, "", ""))
            a += 1
            while a < b and text[a].isspace():
                a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            found.append((a, b, RUN, "", ""))
            lead = lead and not _WORDS.search(text, a, b)

    while at < n:
        if lead and (h := HEAD.match(text, at)) and fold(h.group(1)) not in ("me", "them", "you") and not ((m := TOKEN.match(text, at)) and m.lastgroup == "label"):
            nobody = all(w.lower() in NOBODY for w in h.group(1).split())
            found.append((h.start(1), h.end(), HEAD_WORD, "nobody" if nobody else "", ""))
            at, lead = h.end(), False
            continue
        m = search(at)
        if m and lead and m.start() > at and not text[at : m.start()].isspace():
            # a lead mark may stand before a head
            marks = _LEADS.match(text, at, m.start())
            if marks and HEAD.match(text, marks.end()):
                run(at, marks.end())
                at = marks.end()
                continue
        if not m:
            run(at, n)
            break
        run(at, m.start())
        kind = next(k for k in ("clock", "label", "sung", "group", "self", "head", "sound") if m.group(k) is not None)
        s = m.group().rstrip()
        a, end = m.start() + len(s) - len(s.lstrip()), m.start() + len(s)
        s = s.strip()
        if kind == "clock":
            whole = s[0] in "[(<（【" and s[-1] in "])>）】" or "-->" in s or "h" in s or s.count(":") == 2 and ("." in s or "," in s)
            found.append((a, end, CLOCK_GROUP if whole else CLOCK, "", s[0] if s[0] in "[(<（【" else ""))
        elif kind == "group":
            inner = s.strip("[](){}<>*（）【】［］〔〕 ")
            form = MARKUP if inner.lower() in ("b", "/b", "i", "/i") else GROUP
            end = _AFTER.match(text, end).end() if form == GROUP else end
            found.append((a, end, form, _inside(inner), s[0]))
        elif kind == "sound":
            word = (m.group("listed") or m.group("cjk") or s.rstrip(".,…，、。")).lower()
            known = "shape" if not (m.group("listed") or m.group("cjk")) else "maybe" if _ambiguous(text, word, a + len(word)) else "list"
            found.append((a, end, SOUND, known, ""))
        else:
            form = {"label": LABEL, "sung": SUNG, "self": SELF, "head": HEAD_MARK}[kind]
            found.append((a, _AFTER.match(text, end).end() if form == SUNG else end, form, "", ""))
        lead = lead and kind not in ("label", "self", "head")
        at = max(end, m.end(), at + 1)
    spoken = labelled = False
    out: list[tuple[int, int, Observation]] = []
    plain = any(f == RUN and _WORDS.search(text, a, b) for a, b, f, _, _ in found)
    for i, (a, b, form, known, mark) in enumerate(found):
        s = text[a:b]
        words = len(_WORDS.findall(s)) if form in (GROUP, HEAD_WORD, HEAD_MARK) else min(len(s), 6) if form == SOUND else 0
        if form == GROUP and any(c.isdigit() for c in s):
            mark += "0"
        # place: before all speech, before it but behind a label, behind it; alone where there are no plain words
        place = "behind" if spoken else "labelled" if labelled else "alone" if not plain else "before"
        after = text[b : b + 1] if form not in (SOUND, RUN) else s[-1] if not s[-1].isalnum() else text[b : b + 1]
        after = "pause" if after in (",", "…", ".", "，", "、", "") and form == SOUND else "end" if not after else "space" if after.isspace() else "mark" if not after.isalnum() else "word"
        tail = s.strip("[](){}<>*（）【】［］〔〕.,!?;…，、。！？ ").lower()[-3:] if form == GROUP else ""
        out.append((a, b, (form, known, mark, _case(s) if form in (GROUP, SOUND, HEAD_WORD) else "", min(words, 6), place, after, tail)))
        spoken = spoken or form == RUN and bool(_WORDS.search(s))
        labelled = labelled or form in (LABEL, SELF, HEAD_MARK, HEAD_WORD, LEAD)
    return out


def allowed(text: str, toks: list[tuple[int, int, Observation]], number: int | None, shown: str | None) -> list[tuple[int, ...]]:
    """The tags that a text's tokens may have when the model is counted; most are certain, the others stay open.

    A group or a head that gives the name of the row's own speaker (``shown``) is confirmed as a speaker, one that numbers
    the row's own speaker likewise.
    """
    own = {fold(shown), fold(shown.split()[0])} if shown and shown.split() else set()
    out: list[tuple[int, ...]] = []
    for a, b, (form, known, mark, case, words, place, _, _) in toks:
        first = place != "behind"
        k, name = label_of(text[a:b]) if form in (LABEL, GROUP, HEAD_MARK, HEAD_WORD) else (None, None)
        sure = name in own or k is not None and k == number
        if form == CLOCK_GROUP or form == CLOCK and first:
            tags: tuple[int, ...] = (TIME,)
        elif form == SUNG or known == "note":
            tags = (NOTE,)
        elif form == MARKUP or first and (sure or form in (LABEL, SELF, HEAD_MARK, LEAD)):
            tags = (SPEAKER,)
        elif form == SOUND:
            tags = (FILLER,) if known == "list" else (SPEECH,) if known == "maybe" and place != "alone" else (FILLER, SPEECH)
        elif form == GROUP and known != "mail" and words <= 4 and not mark.endswith("0"):
            # names are capitalised where a script can, and mostly the row's own
            tags = (SPEAKER, NOTE) if first and case != "lower" and not own else (NOTE,)
        elif form == HEAD_WORD and known != "nobody":
            tags = (SPEAKER,) if place == "alone" else (SPEAKER, SPEECH)
        else:
            tags = (SPEECH,)
        out.append(tags)
    return out


#: Lines that every model has seen, so that no form is unknown to a small sample.
SEEDS = ("♪ music ♪", "[music] (laughs)", "hello there ♪ music ♪", "Speaker 1: hello there", "Me: hello", "**Ann:** hello", "Ann: hello", "[Ann] hello", "- hello", ">> um, hello", "00:01:02.000 [0:12] hello 12", "um...", "hello (aside) there 5", "at 10:30 we go", "call bob [at] host (on line 5)", "Note: hello", "<b>hello")


class Tagger:
    """Hidden Markov model of tags over observed tokens.

    A tag emits a token's form and, given both, each of its other features by itself. Counts come from a sample of
    (text, speaker of the row, its name): certain tags count as such, open ones by their posteriors (Baum-Welch), so what
    is in no list is decided by shape, place and neighbours.
    """

    def __init__(self, rows: list[str | tuple[str, int | None, str | None]], smooth: float = 0.1, rounds: int = 6):
        self.smooth, self.known = smooth, {}
        data = []
        for r in [*rows, *SEEDS]:
            text, number, shown = r if isinstance(r, tuple) else (r, None, None)
            if toks := tokens(text):
                may = np.full((len(toks), len(TAGS)), -np.inf)
                for row, tags in zip(may, allowed(text, toks, number, shown)):
                    row[list(tags)] = 0
                data.append(([o for _, _, o in toks], may))
        weights = [np.exp(m - np.log(np.exp(m).sum(1, keepdims=True))) for _, m in data]
        pairs = [w[:-1].T @ w[1:] for w in weights]
        unsure = [i for i, (_, m) in enumerate(data) if (np.isfinite(m).sum(1) > 1).any()]  # the others' tags stay
        for r in range(rounds):
            self._count([o for o, _ in data], weights, pairs)
            if r < rounds - 1:
                for i in unsure:
                    weights[i], pairs[i] = self._posterior(*data[i])

    def _count(self, rows: list[list[Observation]], weights: list[np.ndarray], pairs: list[np.ndarray]) -> None:
        k = len(TAGS)
        first, step = np.full(k, self.smooth), np.full((k, k), self.smooth)
        self.form = np.full((k, len(FORMS)), self.smooth * 0.1)
        self.rest: list[dict[tuple[int, object], np.ndarray]] = [{} for _ in range(7)]
        for obs, w, p in zip(rows, weights, pairs):
            first += w[0]
            step += p
            for o, x in zip(obs, w):
                self.form[:, o[0]] += x
                for table, v in zip(self.rest, o[1:]):
                    if (o[0], v) not in table:
                        table[o[0], v] = np.zeros(k)
                    table[o[0], v] += x
        norm = lambda a: np.log(a / a.sum(-1, keepdims=True))
        self.first, self.step, self.of_form = norm(first), norm(step), norm(self.form)
        self.known = {}

    def emission(self, o: Observation) -> np.ndarray:
        """Log likelihood of an observation by each tag."""
        if (e := self.known.get(o)) is None:
            e = self.of_form[:, o[0]].copy()
            whole = self.form[:, o[0]]
            for table, v in zip(self.rest, o[1:]):
                if (n := table.get((o[0], v))) is not None:  # a value never seen speaks for no tag
                    e += np.log((n + self.smooth) / (whole + self.smooth * 8))
            self.known[o] = e
        return e

    def _posterior(self, obs: list[Observation], may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior tags of a row's tokens, and expected steps between tags, among those it may have."""
        e = np.stack([self.emission(o) for o in obs]) + may
        n, (k, _) = len(obs), self.step.shape
        ahead, back = np.empty((n, k)), np.zeros((n, k))
        log = lambda x, axis: (m := np.maximum(x.max(axis), -1e300)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis) + 1e-300)
        ahead[0] = self.first + e[0]
        for t in range(1, n):
            ahead[t] = log(ahead[t - 1][:, None] + self.step, 0) + e[t]
        for t in range(n - 2, -1, -1):
            back[t] = log(self.step + (e[t + 1] + back[t + 1])[None], 1)
        whole = log(ahead[-1], 0)
        pairs = np.zeros((k, k))
        for t in range(n - 1):
            pairs += np.exp(ahead[t][:, None] + self.step + (e[t + 1] + back[t + 1])[None] - whole)
        return np.exp(ahead + back - whole), pairs

    def decode(self, rows: list[list[Observation]]) -> list[np.ndarray]:
        """The best tags of each row of observations, by Viterbi over rows of similar length at once."""
        seen: dict[Observation, int] = {}
        coded = [[seen.setdefault(o, len(seen)) for o in r] for r in rows]
        emit = np.stack([self.emission(o) for o in seen], 1) if seen else np.zeros((len(TAGS), 0))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
        order = sorted((i for i in range(len(rows)) if rows[i]), key=lambda i: len(rows[i]))
        a = 0
        while a < len(order):
            longest = len(rows[order[min(len(order), a + 1024) - 1]])
            b = min(len(order), a + max(1, min(1024, 400_000 // longest)))
            part = order[a:b]
            size = np.array([len(rows[i]) for i in part])
            n, m = len(part), int(size.max())
            x = np.zeros((n, m), np.int64)
            x[np.arange(m)[None, :] < size[:, None]] = np.concatenate([coded[i] for i in part])
            score = self.first + emit[:, x[:, 0]].T
            back = np.zeros((n, m, len(TAGS)), np.int8)
            last = np.where((size == 1)[:, None], score, 0)
            for t in range(1, m):
                s = score[:, :, None] + self.step[None]
                back[:, t] = s.argmax(1)
                score = s.max(1) + emit[:, x[:, t]].T
                last = np.where((size == t + 1)[:, None], score, last)
            tag = last.argmax(1)
            path = np.zeros((n, m), np.int8)
            r = np.arange(n)
            for t in range(m - 1, -1, -1):
                live = size > t
                path[live, t] = tag[live]
                tag = np.where(live, back[r, t, tag], tag)
            for j, i in enumerate(part):
                out[i] = path[j, : size[j]]
            a = b
        return out


_DIGITS = {c: str(unicodedata.digit(c)) for base in (0x660, 0x6F0, 0x966, 0xE50, 0xFF10) for c in map(chr, range(base, base + 10))}


def label_of(s: str) -> tuple[int | None, str | None]:
    """The speaker (from 0) that a label numbers, or the folded name it gives; (None, None) if neither."""
    t = "".join(_DIGITS.get(c, c) for c in s).lower()
    if m := re.search(rf"(?:{_ROLE})_(\d+)", t):
        return int(m.group(1)), None
    if m := re.search(rf"(?:{_ROLE})\s*#?\s*({_NUM})", t):
        k = m.group(1)
        return max(0, (int(k) if k.isdigit() else NUMBER[k]) - 1), None
    if m := re.fullmatch(r"\W*s(\d+)\W*", t):
        return max(0, int(m.group(1)) - 1), None
    name = fold(re.sub(r"</?b>|[\[\](){}<>*:：（）【】［］]", "", s))
    return None, name or None


def read(text: str, toks: list[tuple[int, int, Observation]], tags: np.ndarray) -> tuple[str, str, int | None, str | None]:
    """(spoken text, text of an unconfirmed head, speaker number, folded name) of a tagged text."""
    number = name = None
    head, parts, at = "", [], 0
    for (a, b, o), tag in zip(toks, tags):
        if tag == SPEECH:
            continue
        if tag == SPEAKER or o[0] == GROUP and tag == NOTE and not parts:
            k, nm = label_of(text[a:b])
            if o[0] == LABEL and number is None and name is None:
                number = k
            elif o[0] in (HEAD_MARK, HEAD_WORD, GROUP) and number is None and name is None:
                number, name = k, nm
                if o[0] == HEAD_WORD:
                    head = text[a:b]
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    spoken = re.sub(r"\s+", " ", " ".join(p.strip() for p in parts if p.strip())).strip()
    spoken = re.sub(r"^(?:[,，、.…]+\s*)+|^[>\-–—•\s]+(?=\S)", "", spoken)
    if not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" for c in spoken):
        spoken = ""
    return spoken, head, number, name


TAGGED = T.StructType([T.StructField("spoken", T.StringType()), T.StructField("head", T.StringType()), T.StructField("number", T.LongType()), T.StructField("name", T.StringType())])


def tag_texts(texts: list[str | None], model: Tagger) -> list[tuple[str, str, int | None, str | None]]:
    """:func:`read` of every text; distinct texts are decoded once."""
    todo = [(t, tokens(t)) for t in dict.fromkeys(t for t in texts if t)]
    out = {t: read(t, toks, tags) for (t, toks), tags in zip(todo, model.decode([[o for _, _, o in x] for _, x in todo]))}
    return [out[t] if t else ("", "", None, None) for t in texts]


def train(segments: DataFrame, text: str, sample: int = 4000, participants: DataFrame | None = None) -> Tagger:
    """A tagger counted from at most ``sample`` texts, taken in hash order (so that the same rows give the same model).

    With ``participants`` the names of the rows' own speakers confirm labels (segments then need meeting_id, speaker).
    """
    t = F.col(text)
    pool = segments.filter(t.isNotNull() & (F.char_length(t) < 2000))
    if participants is None:
        rows = pool.select(t.alias("t"), F.xxhash64(t).alias("h")).orderBy("h", "t").limit(sample).collect()
        return Tagger([r.t for r in rows])
    own = ["meeting_id", F.col("speaker").cast("bigint").alias("speaker")]
    few = pool.select(t.alias("t"), F.xxhash64(t).alias("h"), *own).orderBy("h", "t", "meeting_id", "speaker").limit(sample)
    keys = ["meeting_id", "speaker"]
    names = participants.select(*own, "display_name").join(F.broadcast(few.select(*keys).distinct()), keys, "left_semi").groupBy(*keys).agg(F.min("display_name").alias("shown"))
    rows = few.join(names, keys, "left").orderBy("h", "t", *keys).collect()
    return Tagger([(r.t, r.speaker, r.shown) for r in rows])


def speaker_turns(segments: DataFrame, participants: DataFrame, sample: int = 4000, shard_ms: int = 3_600_000) -> DataFrame:
    """Turns ``(meeting_id, source, speaker, start_ms, end_ms, n_segments, text)``.

    ``segments`` has meeting_id, idx, start_ms, end_ms, speaker, source, text; ``participants`` meeting_id, speaker,
    display_name. Double deliveries (equal in all these columns) count once; segments whose text is null, blank or
    without speech are left out. A label that numbers or names a speaker of the meeting holds over the column; an
    unknown speaker is -1, and unknown equals unknown, as null sources equal null. A null meeting_id is a meeting of its
    own; a null start sorts first. Ties of start_ms go by idx, then the other columns. Other columns are ignored.
    """
    model = train(segments, "text", sample, participants)
    cols = ["meeting_id", "idx", "start_ms", "end_ms", "speaker", "source", "text"]
    seg = segments.select("meeting_id", *[F.col(c).cast("bigint").alias(c) for c in cols[1:5]], "source", "text").filter(F.col("text").rlike(r"\S"))
    schema = T.StructType([f for f in seg.schema.fields] + TAGGED.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = tag_texts(b["text"].tolist(), model)
            extra = pd.DataFrame(got, columns=["spoken", "head", "number", "name"], index=b.index)
            extra["number"] = extra["number"].astype("Int64")
            yield pd.concat([b, extra], axis=1)

    tagged = spread(seg).mapInPandas(run, schema)
    # names: the full one or its first part, within the meeting; a key of two speakers names nobody. Meetings of many
    # labelled rows are spread by a salt, over which the few participants are repeated.
    salts = 16
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"[\s\x{a0}\x{3000}]+", ""))
    shown = F.col("display_name")
    who = participants.filter(shown.isNotNull() & F.col("speaker").isNotNull()).select(
        F.col("meeting_id").alias("p_meeting"), F.col("speaker").cast("bigint").alias("named"), F.explode(F.array_distinct(F.array(squeeze(shown), squeeze(F.split(F.trim(shown), r"[\s\x{3000}]+")[0])))).alias("key")
    )
    who = who.filter("key != ''").groupBy("p_meeting", "key").agg(F.min("named").alias("named"), F.max("named").alias("other")).filter("named = other").drop("other")
    who = who.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tagged = tagged.withColumn("p_salt", F.when(F.col("name").isNotNull(), F.pmod(F.xxhash64("start_ms", "text"), F.lit(salts)).cast("int")))
    joined = tagged.join(who, (F.col("meeting_id") == F.col("p_meeting")) & (F.col("name") == F.col("key")) & (F.col("p_salt") == F.col("salt")), "left")
    said = joined.select(
        *cols,
        F.coalesce("number", "named", "speaker", F.lit(-1).cast("bigint")).alias("who"),
        F.when(F.col("named").isNull() & (F.col("head") != "") & (F.col("spoken") != ""), F.concat_ws(" ", "head", "spoken")).otherwise(F.col("spoken")).alias("spoken"),
    )
    shard = F.expr(f"(start_ms - pmod(start_ms, {shard_ms}L)) div {shard_ms}L")
    said = said.filter("spoken != ''").withColumn("shard", shard)
    inside = Window.partitionBy("meeting_id", "shard").orderBy("start_ms", "idx", "end_ms", "speaker", "source", "text")
    before = F.lag(F.struct(*cols)).over(inside)
    once = said.withColumn("before", before).filter(F.col("before").isNull() | ~F.struct(*cols).eqNullSafe(F.col("before"))).drop("before")
    key = F.struct("source", "who")
    marked = (
        once.withColumn("n", F.row_number().over(inside))
        .withColumn("prev", F.lag(key).over(inside))
        .withColumn("opens", F.when(F.col("prev").isNull() | ~key.eqNullSafe(F.col("prev")), F.col("n")))
        .withColumn("run", F.max("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("prev", "opens")
    )
    # runs within an hour, then across hours: a run's key is (shard, run) of its first row
    local = marked.groupBy("meeting_id", "shard", "run").agg(
        F.first("source").alias("source"),
        F.first("who").alias("speaker"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count("*").alias("n_segments"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "spoken"))), lambda x: x.spoken), " ").alias("text"),
    )
    return _across(local)


def _across(local: DataFrame) -> DataFrame:
    """Joins the last run of an hour with an equal first run of the meeting's next hour that has any.

    One summary row per (meeting, hour) passes the window over a meeting; only runs that touch an hour's end are
    grouped again.
    """
    local = cut(local)
    who = lambda r: F.struct(F.col(f"{r}.source").alias("source"), F.col(f"{r}.speaker").alias("speaker"))
    ends = local.groupBy("meeting_id", "shard").agg(F.min(F.struct("run", "source", "speaker")).alias("a"), F.max(F.struct("run", "source", "speaker")).alias("z"))
    over = Window.partitionBy("meeting_id").orderBy("shard")
    ends = ends.withColumn("before", F.lag(who("z")).over(over)).withColumn("joins", F.coalesce(who("a").eqNullSafe(F.col("before")) & F.col("before").isNotNull(), F.lit(False)))
    # the run open at an hour's first row began in the last hour that has a start of it
    ends = ends.withColumn("single", F.col("a.run") == F.col("z.run"))
    ends = ends.withColumn("started", F.when(~F.col("single") | ~F.col("joins"), F.struct(F.col("shard"), F.col("z.run").alias("run"))))
    ends = ends.withColumn("origin", F.last("started", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    # a later run of the meeting joins mine: mark both sides
    ends = ends.withColumn("joined_by", F.coalesce(F.lead("joins").over(over), F.lit(False)))
    touched = ends.filter("joins OR joined_by").select(F.col("meeting_id").alias("m"), F.col("shard").alias("s"), "joins", "joined_by", "origin", F.col("a.run").alias("first_run"), F.col("z.run").alias("last_run"))
    d = local.join(touched, F.col("meeting_id").eqNullSafe(F.col("m")) & F.col("shard").eqNullSafe(F.col("s")), "left")
    head = F.coalesce(F.col("joins") & (F.col("run") == F.col("first_run")), F.lit(False))
    tail = F.coalesce(F.col("joined_by") & (F.col("run") == F.col("last_run")), F.lit(False))
    d = d.withColumn("key", F.when(head, F.col("origin")).when(tail, F.struct("shard", "run")))
    out = ["meeting_id", "source", "speaker", "start_ms", "end_ms", "n_segments", "text"]
    whole = d.filter("key IS NULL").select(*out)
    stitched = (
        d.filter("key IS NOT NULL")
        .groupBy("meeting_id", "key")
        .agg(
            F.first("source").alias("source"),
            F.first("speaker").alias("speaker"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.sum("n_segments").alias("n_segments"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "text"))), lambda x: x.text), " ").alias("text"),
        )
        .select(*out)
    )
    return whole.unionByName(stitched)
