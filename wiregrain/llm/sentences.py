"""Sentence boundaries by cascading tables of ordered break and no-break rules per language.

A text is cut into blocks (an empty line always ends one; a heading line or a
list item is a block of its own). Within a block a run of final marks with the
closing quotes and brackets behind it, or white space between Thai letters, is
a candidate. Each rule is a pair of regular expressions, for what stands
before and after a position; the tables are asked in the order of the cascade,
and the first rule that fits decides.

The script around a position chooses the cascade. In Latin script the table of
one language is part of it: abbreviations of one language are words of
another ("art", "ex", "max"). The language is guessed from the function words
of the sentence so far, then of its block, then of the text; only where all
three say nothing are the tables of all languages asked. Language labels are
not used, since they are missing or wrong and texts change language from one
paragraph to the next.

A quotation that closes within its block is not cut inside.

Defined results: null and empty texts and texts of white space only give no
sentences; offsets count code points; the sentences of a text cover everything
but white space; repeated texts are cut alike; labels are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import spread


class Rule(NamedTuple):
    """Break (or not) where ``before`` ends and ``after`` begins. ``speech``: ``before`` may span a whole quotation."""

    breaks: bool
    before: str
    after: str
    speech: bool = False


_UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽА-ЯЁІЇЄҐΑ-Ω]"
_LOW = r"[a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžа-яёіїєґα-ω]"
_CLOSE = "[\"'”’»›)\\]}」』）】》〉｣]"
_GAP = r"\s+"

# Abbreviations by language, without the final full stop.
_TITLES = {  # stand before a name: never the end of a sentence
    "en": "Mr Mrs Ms Dr Prof St Messrs Rev Hon Gen Col Capt Lt Sgt Gov Sen Rep Pres",
    "de": "Hr Fr Frau Dr Prof Dipl Ing",
    "fr": "M MM Mme Mmes Mlle Dr Pr Me St Ste",
    "es": "Sr Sra Srta Sres Dr Dra Prof Profa D Dña Ud Uds Lic Ing",
    "ru": "проф акад им тов ул",
    "hi": "डॉ श्री सुश्री प्रो पं कु",
    "ar": "د أ م ص ج",
}
_NAMED = {  # stand before what they belong to: the end only before a word that begins sentences
    "en": "Fig Figs Sec Eq Ch Vol Nos approx vs cf viz",
    "de": "Nr Abb Abs Art Bd Bsp bzw ca evtl ggf inkl exkl max min Mio Mrd sog Std Tel usf vgl zzgl",
    "fr": "env cf chap fig ex art vol éd",
    "es": "aprox núm pág págs fig art cap vol tel",
    "ru": "стр рис табл ок см ср напр",
}
_NUMBERED = {"en": "no fig sec vol art pp p ch eq nr", "de": "Kap S", "fr": "no nos n p", "es": "n p nro no", "ru": "с п"}  # only before a number
_LOOSE = {  # may end a sentence: the next word decides
    "en": "a.m p.m etc Inc Ltd Co Corp Bros Jr Sr U.S U.K al",
    "de": "usw etc GmbH Co AG",
    "fr": "etc",
    "es": "etc EE.UU Cía S.A",
    "ru": "т.д т.п др пр руб коп тыс млн млрд г гг",
}
# Function words by language. They tell the language of a text, and in upper case they begin a sentence.
_FUNCTION = {
    "en": "the a an and or of to in is was are were it its he she they we you this that these those for with on at by from not but then when after there if as be has have had will no our your their all some each what why how",
    "de": "der die das den dem des ein eine einen einem einer und oder zu im ist war sind waren es er sie wir ihr dies dieser diese dieses für mit auf bei von aus nicht aber dann wenn nach dort als auch hat haben hatte wird kein keine alle jede was warum wie noch",
    "fr": "le la les a un une des et ou du de au aux est était sont il elle ils elles nous vous ce cette ces pour avec sur par dans ne pas mais puis quand après si comme ont avait sera aucun tous chaque que qui pourquoi",
    "es": "el la los las a un una unos unas y o de del al es era son eran él ella ellos nosotros este esta estos estas para con por en no pero luego cuando después si como ha han había será ningún todos cada que qué quien cómo se su",
}
# of several parts, with or without a space between them; never the end
_PARTED = "e.g i.e z.B d.h u.a o.ä s.o s.u z.T i.d.R p.ex p.ej т.е т.к т.н и.о"
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez"
# words in lower case that begin a sentence although their case says otherwise: program names
_PROGRAMS = "curl wget nginx iptables openssl"
_JOINS = "and but or nor then y e o u pero et mais puis ou und aber oder и а но или"


def _words(text: str, split: str = " ") -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+").replace("\\.", r"\.\s?") for w in sorted(text.split(split), key=len, reverse=True))


def _inner(words: str) -> tuple[str, str]:
    """What may stand before and after an inner full stop of abbreviations of several parts."""
    left, right = set(), set()
    for w in words.split():
        parts = w.split(".")
        left.update(parts[:-1])
        right.update(parts[1:])
    return tuple("|".join(sorted(map(re.escape, x), key=len, reverse=True)) for x in (left, right))


def _all(table: dict[str, str]) -> str:
    return "|".join(_words(v) for v in table.values())


_PARTS = _inner(" ".join([_PARTED, *_LOOSE.values()]))
# titles that are a word in no other language hold in texts of any
_FOREIGN = [w for k in ("en", "de", "fr", "es") for w in _TITLES[k].split() if len(w) > 1 and w not in ("Me", "MM", "Pr", "Fr", "Ing")]
_BEGINS = r"(?:" + "|".join(sorted({w.capitalize() for words in _FUNCTION.values() for w in words.split() if len(w) > 1})) + r")(?!\w)"


def _named_rules(languages: tuple[str, ...]) -> list[Rule]:
    """The table of abbreviations of some languages."""

    def of(table: dict[str, str]) -> str:
        return _all({k: v for k, v in table.items() if k in languages}) or r"(?!)"

    titles = "|".join((_words(" ".join(_FOREIGN)), of(_TITLES)))
    return [
        Rule(False, rf"(?<!\w)(?:{titles})\.", rf"{_GAP}\S|[^\s]"),
        Rule(True, rf"(?<!\w)(?:{of(_NAMED)})\.", rf"{_GAP}{_BEGINS}"),
        Rule(False, rf"(?<!\w)(?:{of(_NAMED)})\.", rf"{_GAP}\S|[^\s]"),
        Rule(False, rf"(?<!\w)(?:{of(_NUMBERED)})\.", rf"{_GAP}[0-9#]"),
    ]


_LATIN = ("en", "de", "fr", "es")
#: rule tables by name
TABLES: dict[str, list[Rule]] = {
    # A final mark inside a token is no end: versions, decimals, hosts, files, addresses.
    "token": [
        # a unit or an abbreviation that ends a sentence, the space forgotten
        Rule(True, r"[0-9]\s[a-zµ]{1,3}\.", rf"{_UP}(?:{_LOW}|\s)"),
        Rule(True, rf"(?<!\w)(?:{_words('a.m p.m etc Inc Ltd Co Corp usw')})\.", rf"{_UP}(?:{_LOW}|\s)"),
        Rule(False, r"[.!?…]", r"[,;:]"),
        Rule(False, r"[0-9]\.", r"[0-9]"),
        Rule(False, r"[.?!]", r"[a-z0-9_/&=%#@~\-]"),
        Rule(False, r"(?<![^\W_])[^\W\d_]\.", r"[^\W\d_]"),
    ],
    "quotation": [
        # speech goes on with who said it
        Rule(False, rf"{_CLOSE}", r"\s*[,;:]"),
        Rule(False, rf"{_CLOSE}", r"\s*[–—-]\s"),
        Rule(True, rf"[.!?…]{_CLOSE}", rf"{_GAP}(?:{_words(_PROGRAMS)})\s"),
        Rule(False, rf":\s*[\"“„«][^\"”“»]*[.!?…]\s?{_CLOSE}", rf"{_GAP}(?:{_words(_JOINS)})\s", True),
        Rule(True, rf":\s*[\"“„«][^\"”“»]*[.!?…]\s?{_CLOSE}", _GAP, True),
        Rule(False, rf"{_CLOSE}", rf"{_GAP}{_LOW}"),
    ],
    **{f"latin {k}": _named_rules((k,)) for k in _LATIN},
    "latin any": _named_rules(_LATIN),
    "cyrillic": _named_rules(("ru",)),
    "latin": [
        Rule(False, rf"(?<!\w)(?:{_words(_PARTED)})\.", r"\s*\S"),
        Rule(False, rf"(?<!\w)(?:{_PARTS[0]})\.", rf"\s?(?:{_PARTS[1]})\."),
        # a letter that is no initial, since a sentence begins behind it
        Rule(True, rf"(?<![\w'’.])(?<!\w\.\s)(?:{_UP})\.", rf"{_GAP}{_BEGINS}"),
        # initials before a name or another initial
        Rule(False, rf"(?<![\w'’])(?:{_UP})\.", rf"{_GAP}(?:{_UP}\.|{_UP}{_LOW})"),
        # abbreviations that may end a sentence
        Rule(True, rf"(?<!\w)(?:{_all(_LOOSE)})\.", rf"{_GAP}(?:{_words(_PROGRAMS)})\s"),
        Rule(False, rf"(?<!\w)(?:{_all(_LOOSE)})\.", rf"\s*[{_LOW[1:-1]}(,;:–—-]"),
        # German ordinals
        Rule(False, r"(?<![\w.,])[0-9]{1,2}\.", rf"{_GAP}(?:{_words(_MONTHS)})\b"),
        # an ellipsis inside a sentence
        Rule(False, r"(?:\.\.+|…+)", rf"\s*{_LOW}"),
        # what is left ends a sentence, with or without a space
        Rule(True, rf"[.!?…]\s?{_CLOSE}*", _GAP),
        Rule(True, rf"[!?]\s?{_CLOSE}*", rf"[{_UP[1:-1]}¿¡\"“„«(]"),
        Rule(True, rf"[^\W\d_]{{2}}\.{_CLOSE}*|[0-9)%}}\]]\.{_CLOSE}*", rf"(?:{_UP}|[¿¡])"),
        Rule(True, rf"[.!?…]\s?{_CLOSE}*", r"[ऀ-ॿ؀-ۿ฀-๿぀-ヿ一-鿿]"),
    ],
    "han_kana": [
        Rule(False, r"[0-9]．", r"[0-9]"),
        Rule(False, r"(?:…+|\.\.+|・・・+)", r"[^\s]"),
        # Japanese: a quoted sentence that is part of another one
        Rule(False, r"[。！？!?．][」』）”]+", r"(?:と|って|という|など|の|は|が|を|に|も|で|だ|や|から|まで|より|へ)"),
        Rule(False, r"[。！？!?．][”’」』]+", r"[，、；：,;—]"),
        # a quotation after a colon ends with its sentence; one within running text does not end it
        Rule(True, r"[：:]\s*[“「『\"][^“”「」『』]*[。！？!?．…]+[”」』\"]+", r"\s*\S", True),
        Rule(False, r"[^\s。！？!?．：:”」』“「『][“「『][^“”「」『』]*[。！？!?．…]+[”」』]+", r"\S", True),
        Rule(False, r"[”’」』]", r"(?:他|她|我|我们|他们|工程师|同事)?(?:说|问|写|喊|答|道)"),
        Rule(True, rf"[。！？．｡!?]{_CLOSE}*", r"\s*\S"),
        Rule(True, rf"[.…]{_CLOSE}*", r"\s+\S"),
        Rule(True, rf"[.]{_CLOSE}*", r"[぀-ヿ一-鿿]"),
    ],
    "devanagari": [
        Rule(False, rf"(?<!\w)(?:{_words(_TITLES['hi'])})\.", r"\s*\S"),
        Rule(False, r"(?:…+|\.\.+)", r"\s*[ऀ-ॿ]"),
        Rule(True, rf"[।॥!?.]{_CLOSE}*", r"\s*\S"),
    ],
    "arabic": [
        Rule(False, rf"(?<!\w)(?:{_words(_TITLES['ar'])})\.", r"\s*\S"),
        Rule(False, r"(?:…+|\.\.+)", r"\s*[؀-ۿ]"),
        Rule(True, rf"[؟۔!?]{_CLOSE}*", r"\s*\S"),
        Rule(True, rf"[.]{_CLOSE}*", r"\s+\S|[؀-ۿ]"),
    ],
    "thai": [
        Rule(True, r"[฀-๿][!?.]*", r"\s+[฀-๿]"),
        Rule(True, rf"[.!?]{_CLOSE}*", r"\s+[฀-๿]"),
    ],
}

#: (script around the position, tables in order); "*" stands for the table of the language
CASCADE: list[tuple[re.Pattern[str], tuple[str, ...]]] = [
    (re.compile(r"[。！？．｡][\"”’」』）》】]*\Z|[぀-ヿ一-鿿][.!?…]+[\"”’」』）》】]*\Z"), ("han_kana",)),
    (re.compile(r"(?:[।॥]+[.!?]*|[ऀ-ॿ][.!?…]+)[\"”’»)]*\Z"), ("quotation", "devanagari")),
    (re.compile(r"(?:[؟۔]+[.!?]*|[؀-ۿ][.!?…]+)[\"”’»)]*\Z"), ("quotation", "arabic")),
    (re.compile(r"[฀-๿][.!?…]*\Z"), ("thai",)),
    (re.compile(r"[Ѐ-ӿ][.!?…]+[\"”’»)]*\Z"), ("token", "quotation", "cyrillic", "latin")),
    (re.compile(r""), ("token", "quotation", "*", "latin")),
]

# a mark inside a token of ASCII letters and digits is none: no table breaks there
_CANDIDATE = re.compile(rf"(?:[…。！？．｡।॥؟۔]|[.!?](?:(?<![A-Za-z0-9].)|(?![a-z0-9_/\-]))|\s(?=[!?]))+(?:\s(?=»)|{_CLOSE})*|(?<=[฀-๿])(?=\s+[฀-๿])")
_QUOTES = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"|「[^「」]*」|『[^『』]*』|‘[^‘’]*’(?!\w)")
_BREAK_LINE = re.compile(r"\r\n|[\n\r  \x85\x0b\x0c]")
_BULLET = re.compile(r"[ \t]*(?:[-*+•‣◦▪·]|[–—](?=\s+\S+\s*\S*\Z))[ \t]+\S")
_NUMBER = re.compile(r"[ \t]*(?:\(?[0-9]{1,3}[.)]|\(?[A-Za-z]\))[ \t]+\S")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")


# what stands before a position: as far back as the longest abbreviation with its spaces and one character more
_REACH = 2 + max(2 * len(w) for table in (_TITLES, _NAMED, _NUMBERED, _LOOSE) for words in table.values() for w in words.split())
_ABBREVIATIONS = frozenset(w for table in (_TITLES, _NAMED, _NUMBERED) for k in _LATIN for w in table[k].split())
# every word or part of a word that some rule about abbreviations names
_NAMES = frozenset(part for table in (_TITLES, _NAMED, _NUMBERED, _LOOSE) for words in table.values() for w in words.split() for part in (w, *w.split("."))) | frozenset(
    part for w in _PARTED.split() for part in w.split(".")
)
_WORD = re.compile(r"[^\W\d_]+")
_LANGUAGE_OF: dict[str, tuple[str, ...]] = {}
for _language, _list in _FUNCTION.items():
    for _w in _list.split():
        _LANGUAGE_OF[_w] = (*_LANGUAGE_OF.get(_w, ()), _language)

_Compiled = tuple[tuple[bool, re.Pattern[str], re.Pattern[str], bool], ...]


def language(text: str) -> str:
    """The language whose function words a text has most of; "" where none or several have most."""
    votes = dict.fromkeys(_FUNCTION, 0.0)
    for m in _WORD.finditer(text):
        found = _LANGUAGE_OF.get(m.group().lower())
        if found:
            for k in found:
                votes[k] += 1 / len(found)
    best = max(votes.values())
    top = [k for k, n in votes.items() if n == best]
    return top[0] if len(top) == 1 else ""


def _begins(after: str) -> tuple[bool, bool]:
    """Whether a pattern can match text that begins with white space, and text that does not."""
    outer = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:[^()\\]|\\.)*\)", "", after)
    if "|" in outer or after.startswith((r"\s*", r"\s?")) or not after:
        return True, True
    spaced = after.startswith(r"\s")
    return spaced, not spaced


@lru_cache(maxsize=None)
def _compiled(tables: tuple[str, ...], spaced: bool) -> _Compiled:
    rules = [r for name in tables for r in TABLES[name] if _begins(r.after)[0 if spaced else 1]]
    return tuple((r.breaks, re.compile(f"(?:{r.before})\\Z"), re.compile(r.after), r.speech) for r in rules)


@lru_cache(maxsize=None)
def _with(tables: tuple[str, ...], own: str) -> tuple[str, ...]:
    """Tables with that of a language in its place, or none."""
    return tuple(own if t == "*" else t for t in tables if own or t != "*")


_CLOSING = frozenset("\"'”’»›)]}」』）】》〉｣")
_OPENING = '"“„«「『'


class Block:
    """A block of a text, with what its rules need to know beyond a position."""

    def __init__(self, block: str, text: str) -> None:
        self.block, self.text = block, text
        self.end = len(block.rstrip())
        self.around: str | None = None

    def language_at(self, start: int, end: int) -> str:
        """The language of the sentence so far, else of the block, else of the text."""
        own = language(self.block[start:end])
        if not own and self.around is None:
            self.around = language(self.block) or language(self.text)
        return own or self.around or ""

    def speech(self, run: int, end: int) -> str:
        """What stands before ``end``, back to the quotation that closes there and the character before it."""
        at = max(self.block.rfind(q, 0, run) for q in _OPENING)
        while at > 0 and self.block[at - 1].isspace():
            at -= 1
        return self.block[max(at - 1, 0) : end]

    def is_break(self, run: int, end: int, sentence: int) -> bool:
        """What the first fitting rule of the cascade says of ``end``; no rule, no break.

        ``run`` is where the final marks before it begin, ``sentence`` where the sentence does.
        """
        block = self.block
        if end - run == 1 and block[run] in ".!?" and block[end].isspace() and block[run - 1 : run] < "\u0530":
            # one mark behind a word that no rule names, and space: the last rule for space decides
            at = run
            while at > 0 and block[at - 1].isalpha():
                at -= 1
            if run - at > 1 and block[at:run] not in _NAMES and (at == 0 or block[at - 1].isspace()):
                return True
        near = block[max(0, run - _REACH) : end]
        tail = block[max(0, run - 1) : end]
        # the last entry of the cascade is for all scripts, and the only one for ASCII
        tables = CASCADE[-1][1] if tail.isascii() else next(t for script, t in CASCADE if script.search(tail))
        if "*" in tables:
            own = ""
            if block[end - 1] == ".":
                at = end - 1
                while at > sentence and block[at - 1].isalnum():
                    at -= 1
                if block[at : end - 1] in _ABBREVIATIONS:
                    own = "latin " + (self.language_at(sentence, end) or "any")
            tables = _with(tables, own)
        speech: str | None = None
        for breaks, left, right, long in _compiled(tables, block[end].isspace()):
            if not right.match(block, end):
                continue
            if long and speech is None:
                speech = self.speech(run, end) if block[end - 1] in _CLOSING else near
            if left.search(speech if long else near):
                return breaks
        return False


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the blocks of a text."""
    start: int | None = None
    pos, listed = 0, False
    while pos <= len(text):
        m = _BREAK_LINE.search(text, pos)
        end, nxt = (m.start(), m.end()) if m else (len(text), len(text) + 1)
        line = text[pos:end]
        if not line.strip():
            if start is not None:
                yield start, pos
            start, listed = None, False
        else:
            item = bool(_BULLET.match(line)) or (bool(_NUMBER.match(line)) and (start is None or listed))
            if item or _HEADING.match(line):
                if start is not None:
                    yield start, pos
                yield pos, end
                start, listed = None, item
            else:
                if start is None:
                    start = pos
                listed = False
        pos = nxt
    if start is not None:
        yield start, len(text)


def _is_single(block: str) -> bool:
    return bool(_BULLET.match(block) or _NUMBER.match(block) or _HEADING.match(block)) and not _BREAK_LINE.search(block.strip())


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out: list[tuple[int, int]] = []
    for lo, hi in _blocks(text):
        block = text[lo:hi]
        cuts = [0]
        if not _is_single(block):
            asked = Block(block, text)
            quotes = [(m.start(), m.end()) for m in _QUOTES.finditer(block)] if any(q in block for q in '"“„«「『‘') else []
            k = 0
            for m in _CANDIDATE.finditer(block):
                p = m.end()
                while k < len(quotes) and quotes[k][1] < p:
                    k += 1
                if k < len(quotes) and quotes[k][0] < p < quotes[k][1]:
                    continue
                if p < asked.end and asked.is_break(m.start(), p, cuts[-1]):
                    cuts.append(p)
        cuts.append(len(block))
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = block[a:b]
            left = len(part) - len(part.lstrip())
            body = part.strip()
            if body:
                out.append((lo + a + left, lo + a + left + len(body)))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, starts, ends = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for n, (a, b) in enumerate(sentences(text)):
                ids.append(doc)
                numbers.append(n)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["doc_id", "sent_no", "start_char", "end_char"],
        )


def document_sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sent_no, start_char, end_char of every sentence; a single pass without shuffle."""
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    return spread(texts).mapInArrow(_cut, f"doc_id {dict(texts.dtypes)['doc_id']}, sent_no int, start_char bigint, end_char bigint")
