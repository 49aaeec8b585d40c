"""Held-out evaluation passages in a corpus: one Aho-Corasick automaton over normalised windows.

Every window of ``words`` consecutive words of an evaluation item (of
``letters`` letters for Chinese and Japanese) is a pattern, written without
anything but letters and digits. Texts are written the same way and scanned
once; the few that hit are scanned again with every character mapped to its
place in the original, where a hit must begin and end with a whole word. Hits
that overlap or touch are one passage; passages apart are reported apart.

Defined results: null and empty texts and items hold nothing; an item shorter
than a window cannot leak; items with equal windows are all reported; repeated
documents are each reported; labels of language are ignored in documents and
only the script of an item decides how it is cut.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL)
_LINK = re.compile(r"\]\([^()\s]*\)")
_OTHER = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_HAN_KANA = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003134f]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# a character with its combining marks
_CLUSTER = re.compile("(?s).[̀-゙゚ͯ⃐-⃰]*")


def plain(text: str) -> str:
    """Letters and digits only: markup, punctuation, spaces and invisible characters gone, case and width folded."""
    if "<" in text:
        text = _TAG.sub("​", text)
    if "](" in text:
        text = _LINK.sub("​", text)
    if "&" in text:
        text = html.unescape(text)
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def _skipped(text: str) -> list[tuple[int, int, str]]:
    """Spans of the original that stand for something else: markup for nothing, entities for a character."""
    spans = [(m.start(), m.end(), "") for m in _TAG.finditer(text)] + [(m.start(), m.end(), "") for m in _LINK.finditer(text)]
    spans += [(m.start(), m.end(), html.unescape(m.group())) for m in _ENTITY.finditer(text)]
    spans.sort()
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def mapped(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """``plain`` with, per character, its span in the original and whether a word begins there.

    A word goes on across invisible characters, and begins after anything
    visible that is neither letter nor digit, or after markup.
    """
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    begins: list[bool] = []
    fresh, pos = True, 0

    def take(piece: str, at: int, end: int) -> None:
        nonlocal fresh
        for c in unicodedata.normalize("NFKC", piece).casefold():
            if c == "_" or not (c.isalnum() or re.match(r"\w", c)):
                if unicodedata.category(c) not in ("Cf", "Mn", "Cc") or c in "\n\t\r":
                    fresh = True
                continue
            out.append(c)
            starts.append(at)
            ends.append(end)
            begins.append(fresh)
            fresh = False

    for lo, hi, stands_for in [*_skipped(text), (len(text), len(text), "")]:
        for m in _CLUSTER.finditer(text, pos, lo):
            take(m.group(), m.start(), m.end())
        if stands_for:
            take(stands_for, lo, hi)
        elif hi > lo:
            fresh = True
        pos = hi
    return "".join(out), starts, ends, begins


def item_words(text: str) -> list[str]:
    """The words of an item, in order, written plain."""
    flat, _, _, begins = mapped(text)
    words: list[str] = []
    for c, new in zip(flat, begins, strict=True):
        if new or not words:
            words.append(c)
        else:
            words[-1] += c
    return words


def by_letters(text: str) -> bool:
    """True for items in Chinese or Japanese, which are cut by letters."""
    flat = plain(text)
    return 2 * len(_HAN_KANA.findall(flat)) > len(flat)


def windows(text: str, words: int, letters: int) -> tuple[set[str], bool]:
    """The patterns of an item, and whether they are windows of letters."""
    if by_letters(text):
        flat = _DIGITS.sub("", plain(text))
        return {flat[i : i + letters] for i in range(len(flat) - letters + 1)}, True
    parts = item_words(text)
    return {"".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}, False


def build(items: list[tuple[int, str]], words: int, letters: int) -> ahocorasick.Automaton | None:
    """One automaton over the windows of all items; a value is (length, by letters, item ids)."""
    owners: dict[str, tuple[bool, set[int]]] = {}
    for item_id, text in items:
        patterns, lettered = windows(text, words, letters)
        for p in patterns:
            owners.setdefault(p, (lettered, set()))[1].add(item_id)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for p, (lettered, ids) in owners.items():
        automaton.add_word(p, (len(p), lettered, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def leaked_spans(text: str, automaton: ahocorasick.Automaton) -> dict[int, list[tuple[int, int]]]:
    """Items of which a window occurs in a text, with the spans of the original that their windows cover."""
    flat = plain(text)
    wanted = next(iter(automaton.iter(flat)), None) is not None
    digits = not wanted and bool(_DIGITS.search(flat)) and bool(_HAN_KANA.search(flat))
    if not wanted and not (digits and next(iter(automaton.iter(_DIGITS.sub("", flat))), None)):
        return {}
    found: dict[int, list[tuple[int, int]]] = {}

    def note(ids: tuple[int, ...], lo: int, hi: int) -> None:
        for i in ids:
            found.setdefault(i, []).append((lo, hi))

    stream, starts, ends, begins = mapped(text)
    for end, (length, lettered, ids) in automaton.iter(stream):
        first = end - length + 1
        if lettered or (begins[first] and (end + 1 == len(stream) or begins[end + 1])):
            note(ids, starts[first], ends[end])
    if _HAN_KANA.search(stream) and _DIGITS.search(stream):
        kept = [k for k, c in enumerate(stream) if not _DIGITS.match(c)]
        for end, (length, lettered, ids) in automaton.iter("".join(stream[k] for k in kept)):
            if lettered:
                note(ids, starts[kept[end - length + 1]], ends[kept[end]])
    return {i: _joined(spans) for i, spans in found.items()}


# the automaton this worker process built last, by the name of its block
_LAST: dict[str, ahocorasick.Automaton | None] = {}


def automaton_of(key: str, block: Broadcast, words: int, letters: int) -> ahocorasick.Automaton | None:
    """The automaton of a block of items, built once per worker process; one is held at a time."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = build(block.value, words, letters)
    return _LAST[key]


def _scan(block: Broadcast, words: int, letters: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(key, block, words, letters)
        for batch in batches:
            docs, ids, numbers, lo, hi = [], [], [], [], []
            if automaton is not None:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item, spans in leaked_spans(text, automaton).items():
                        for n, (a, b) in enumerate(spans):
                            docs.append(doc)
                            ids.append(item)
                            numbers.append(n)
                            lo.append(a)
                            hi.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, batch.column(0).type), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                names=["doc_id", "item_id", "passage_no", "start_char", "end_char"],
            )

    return run


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_chars`` characters and one item more; a partition is on the driver at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.toLocalIterator():
        if held > block_chars:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    if block:
        yield block


def leaks(documents: DataFrame, eval_items: DataFrame, words: int = 12, letters: int = 24, block_chars: int = 400_000) -> DataFrame:
    """Leaked passages per document and item: doc_id, item_id, passage_no, start_char, end_char.

    The items go to the tasks in blocks of ``block_chars`` characters, so an
    automaton has a size bound (about 0.2 GB) whatever the number of items. A
    block passes through the driver alone, is broadcast, and becomes an
    automaton once per worker process. Each block is one scan of the
    documents.
    """
    spark = documents.sparkSession
    rows = eval_items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, item_id bigint, passage_no int, start_char bigint, end_char bigint"
    out: DataFrame | None = None
    for block in _blocks(rows, block_chars):
        part = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), words, letters), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def leaked_documents(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id and item_id of every leak."""
    return leaks(documents, eval_items).where("passage_no = 0").select("doc_id", "item_id")


def leak_report(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Documents and sources per leaked item, items that leaked nowhere included."""
    found = leaks(documents, eval_items).join(documents.select("doc_id", "source"), "doc_id")
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    return eval_items.select("item_id", "suite", "lang").join(per, "item_id", "left").select("item_id", "suite", "lang", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
