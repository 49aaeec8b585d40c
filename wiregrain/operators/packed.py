"""Several values packed in one field: learned segmentation.

A field is cut at candidate delimiters into chunks; quoted spans and spans in
angle brackets are atomic. Which candidates really separate is not known in
advance, neither for a column nor for one of its fields, and is learned:

* The *lattice* of a field has the chunk borders as nodes and every run of
  chunks that some reading of the field makes a value as edge. A reading says
  which of the field's delimiters separate; within a field a delimiter does so
  everywhere or nowhere, so there are at most ``2 ** delimiters`` readings.
* *Expectation-maximisation* over all distinct fields of a column learns how
  often each value occurs (in how many other fields a run is a value) and how
  often each delimiter separates. A field never supports its own values, so a
  run proves itself only by recurring elsewhere; values that recur nowhere get
  the probability of their characters.
* *Viterbi* takes the likeliest reading of each field.

Where a grammar says that bare values hold no delimiter (``bare=False``, as for
lists whose writers quote such values), a run of several chunks gains nothing
by recurring, so two values that often stand together never become one. The
model of values is a table that is joined, not held; only delimiter shares, character
shares and values so frequent that their number is bounded
(``_HOT`` per learning round) reach the driver.

A grammar may further restrict readings: ``pairs`` drops chunks without ``=``,
``starts`` joins a chunk that cannot begin a value to the one before.

Defined results: null and empty fields give no rows; empty values are skipped
and not counted in ``value_pos``; an empty chunk shows that the delimiters
around it separate; an unclosed quote or bracket is an ordinary character;
repeated fields are separated alike; white space never separates; without a
model nothing separates. If readings are equally likely, the one with more
separators is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import latest_entries, spread, stage

_SPAN = r'"(?:[^"\\]|\\.|"")*"|<[^<>]*>'
_ESCAPE = re.compile(r'\\(.)|""', re.DOTALL)
_WHOLE = re.compile(r'"((?:[^"\\]|\\.|"")*)"', re.DOTALL)
#: a value or field with at least this share of all rows of a join is hot; there are at most ``1 / _HOT`` of them
_HOT = 1e-3
#: share of values that are drawn from the table of known values, the rest is spelled by characters
_KNOWN = 0.5


@dataclass(frozen=True)
class Grammar:
    """How one column may pack its values: candidate delimiters, and what a value must look like.

    ``bare``: a value that holds a delimiter may stand without quotes.
    """

    delimiters: str
    bare: bool = True
    pairs: bool = False
    starts: str = ""


_LIST = Grammar(",;|\t", bare=False)
#: packed headers by side and lower-case name
REQUEST_HEADERS = {"cookie": Grammar(";", bare=False, pairs=True), "x-feature-tags": _LIST, "x-forwarded-for": _LIST}
RESPONSE_HEADERS = {"link": Grammar(",;", bare=False, starts="<"), "x-cache-tags": _LIST, "vary": _LIST}
GRAMMARS = REQUEST_HEADERS | RESPONSE_HEADERS


def _cutter(grammar: Grammar) -> re.Pattern[str]:
    return re.compile(f"({_SPAN})|([{re.escape(grammar.delimiters)}])", re.DOTALL)


def tidy(value: str) -> str:
    """Outer white space goes; quotes around the whole value go with their escapes undone."""
    value = value.strip()
    m = _WHOLE.fullmatch(value)
    return _ESCAPE.sub(lambda e: e.group(1) or '"', m.group(1)) if m else value


@dataclass
class Lattice:
    """The chunks of a field and the borders between them.

    ``chunks``: (start, end) of each chunk that is part of a value.
    ``borders``: per border the delimiter that stands there, or "" where an
    empty or dropped chunk shows that values end there. ``sure``: delimiters
    that separate in this field whatever its reading.
    """

    text: str
    chunks: list[tuple[int, int]] = field(default_factory=list)
    borders: list[str] = field(default_factory=list)
    sure: set[str] = field(default_factory=set)

    @property
    def open(self) -> str:
        """The delimiters of which it is not known whether they separate, in a fixed order."""
        return "".join(sorted(set(self.borders) - {""}))

    def runs(self, separators: str) -> list[tuple[str, int]]:
        """The values of the reading in which ``separators`` separate, and how many chunks each has."""
        out: list[tuple[str, int]] = []
        start = 0
        for i, (_, end) in enumerate(self.chunks):
            if i == len(self.borders) or self.borders[i] == "" or self.borders[i] in separators:
                out.append((tidy(self.text[self.chunks[start][0] : end]), i + 1 - start))
                start = i + 1
        return out

    def values(self, separators: str) -> list[str]:
        """The values of that reading."""
        return [v for v, _ in self.runs(separators)]


def lattice(text: str, grammar: Grammar, cutter: re.Pattern[str]) -> Lattice:
    """The lattice of a field."""
    out = Lattice(text)
    since: list[str] = []  # delimiters since the last chunk that is kept
    cuts = [(m.start(), m.end()) for m in cutter.finditer(text) if m.group(2) is not None]
    start = 0
    for stop, after in [*cuts, (len(text), len(text))]:
        part = text[start:stop].strip()
        if part and not (grammar.pairs and "=" not in part):
            if len(since) == 1 and out.chunks and grammar.starts and not part.startswith(grammar.starts):
                out.chunks[-1] = (out.chunks[-1][0], stop)
            else:
                plain = len(since) == 1 and bool(out.chunks)
                if out.chunks:
                    out.borders.append(since[0] if plain else "")
                if not plain:
                    out.sure.update(since)
                out.chunks.append((start, stop))
            since = []
        if stop < len(text):
            since.append(text[stop])
        start = after
    if out.chunks:
        out.sure.update(since)
    return out


def readings(delimiters: str) -> list[str]:
    """All sets of separators a field with these open delimiters may have, fewest first."""
    sets = [""]
    for d in delimiters:
        sets += [s + d for s in sets]
    return sorted(sets, key=lambda s: (len(s), s))


_NO_VALUE = 0  # stands for runs that are not counted


def _hash(name: str, value: str) -> int:
    h = xxhash.xxh64_intdigest(f"{name}\x1f{value}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


@dataclass
class Spelling:
    """How likely a string of characters is in a column."""

    delimiters: str = ""
    shares: dict[str, float] = field(default_factory=dict)
    total: float = 0.0

    def log(self, value: str, chunks: int) -> float:
        """Log share of a value of this many chunks; its delimiters are not spelled, since a border has a share of its own."""
        room = math.log(self.total + 1e5)
        letters = [c for c in value if c not in self.delimiters]
        return sum(math.log(self.shares.get(c if c < "\x80" else "\x80", 0.0) + 0.5) - room for c in letters) + chunks * math.log(1 - _KNOWN)


@dataclass
class Model:
    """What is learned of one column: how often each delimiter separates, and the mass of its values."""

    separates: dict[str, float] = field(default_factory=dict)
    total: float = 1.0

    def usual(self, delimiters: str) -> str:
        """Those of the delimiters that separate as often as not."""
        return "".join(d for d in delimiters if self.separates.get(d, 0.0) > 0.5 - 1e-6)

    def prior(self, delimiters: str, borders: list[int], separators: str) -> float:
        """Log share of a reading by its borders alone."""
        out = 0.0
        for d, n in zip(delimiters, borders, strict=True):
            p = min(max(self.separates.get(d, 0.5), 1e-9), 1 - 1e-9)
            out += n * math.log(p if d in separators else 1 - p)
        return out


def weights(paths: list[list[int]], spelled: list[float], known: list[float], own: list[float], model: Model, delimiters: str, borders: list[int]) -> list[float]:
    """Log weight of every reading: its borders, and its values as known from other fields or as spelled."""
    value = []
    for s, n, o in zip(spelled, known, own, strict=True):
        share = _KNOWN * max(n - o, 0.0) / max(model.total, 1.0)
        value.append(math.log(share + math.exp(s)) if share > 0 else s)
    return [model.prior(delimiters, borders, r) + sum(value[i] for i in path) for r, path in zip(readings(delimiters), paths, strict=True)]


def posterior(logs: list[float]) -> list[float]:
    top = max(logs)
    shares = [math.exp(x - top) for x in logs]
    total = sum(shares)
    return [s / total for s in shares]


def viterbi(logs: list[float], delimiters: str) -> str:
    """The likeliest reading."""
    best = max(range(len(logs)), key=lambda i: (round(logs[i], 9), i))
    return readings(delimiters)[best]


_PA = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of columns given as ``name type``; types may be nested arrays."""

    def typed(t: str) -> pa.DataType:
        return pa.list_(typed(t[6:-1])) if t.startswith("array<") else _PA[t]

    return pa.schema([(n, typed(t)) for n, t in (c.split() for c in ddl.split(", "))])


_FIELD = (
    "field_id bigint, name string, raw string, n_rows bigint, delimiters string, sure string, borders array<int>, parts array<double>, "
    "hashes array<bigint>, spelled array<double>, paths array<array<int>>, own array<double>"
)
_DECISION = "name string, raw string, n_rows bigint, separators string"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _held(paths: list[list[int]], n: int, shares: list[float]) -> list[float]:
    """How far each run is a value of the field, given the shares of its readings."""
    own = [0.0] * n
    for path, share in zip(paths, shares, strict=True):
        for i in set(path):
            own[i] += share
    return own


def _separated(delimiters: str, borders: list[int], shares: list[float]) -> list[float]:
    """The expected number of borders that separate, per delimiter."""
    return [n * sum(p for r, p in zip(readings(delimiters), shares, strict=True) if d in r) for d, n in zip(delimiters, borders, strict=True)]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for c, n in Counter(raw).items():
                counts[name, c if c < "\x80" else "\x80"] += n
        yield _batch([(*k, n) for k, n in counts.items()], "name string, letter string, n bigint")


def _begin(grammars: dict[str, Grammar], spelling: dict[str, Spelling]):
    """The lattice of every field; all readings are alike to begin with."""
    cutters = {n: _cutter(g) for n, g in grammars.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, name, raw, n_rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                net = lattice(raw, grammars[name], cutters[name])
                ds = net.open
                borders = [net.borders.count(d) for d in ds]
                at: dict[tuple[str, int], int] = {}
                paths = [[at.setdefault(v, len(at)) for v in net.runs(r)] for r in readings(ds)]
                alike = [1 / len(paths)] * len(paths)
                rows.append(
                    (fid, name, raw, n_rows, ds, "".join(sorted(net.sure)), borders, _separated(ds, borders, alike), [_hash(name, v) if n == 1 or grammars[name].bare else _NO_VALUE for v, n in at], [spelling[name].log(*v) for v in at], paths, _held(paths, len(at), alike))
                )
            yield _batch(rows, _FIELD)

    return run


def _expect(models: dict[str, Model], hot: dict[int, float], decide: bool):
    """The E-step: shares of a field's readings by the counts of its values in other fields; or, to decide, the likeliest reading where it is not the usual one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *row, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fid, name, raw, n_rows, ds, sure, borders, _, hashes, spelled, paths, own = row
                counts = {k["hash"]: k["n"] for k in known or ()}
                found = [hot.get(h) or counts.get(h, 0.0) for h in hashes]
                logs = weights(paths, spelled, found, own, models[name], ds, borders)
                if decide:
                    reading = viterbi(logs, ds)
                    if reading != models[name].usual(ds):
                        rows.append((name, raw, n_rows, reading))
                else:
                    shares = posterior(logs)
                    rows.append((fid, name, raw, n_rows, ds, sure, borders, _separated(ds, borders, shares), hashes, spelled, paths, _held(paths, len(hashes), shares)))
            yield _batch(rows, _DECISION if decide else _FIELD)

    return run


def _value_counts(fields: DataFrame) -> DataFrame:
    """In how many fields each run is a value (expected), and in how many it is one in some reading."""
    each = fields.select("name", F.explode(F.arrays_zip("hashes", "own")).alias("v"))
    return each.where(F.col("v.hashes") != _NO_VALUE).groupBy("name", F.col("v.hashes").alias("hash")).agg(F.sum("v.own").alias("n"), F.count(F.lit(1)).alias("n_fields"))


def _separations(fields: DataFrame, most: int) -> list:
    """Borders, and those expected to separate, by column and delimiters: rows bounded by the grammars."""
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("borders", "parts") for i in range(most)]
    return fields.groupBy("name", "delimiters", "sure").agg(F.count(F.lit(1)).alias("n"), *sums).collect()


def _maximise(separations: list, masses: dict[str, float]) -> dict[str, Model]:
    """The M-step: how often each delimiter separates, and the mass of values, per column."""
    sums: dict[tuple[str, str], list[float]] = {}
    for r in separations:
        for d in r["sure"]:
            got = sums.setdefault((r["name"], d), [0.0, 0.0])
            got[0] += r["n"]
            got[1] += r["n"]
        for i, d in enumerate(r["delimiters"]):
            got = sums.setdefault((r["name"], d), [0.0, 0.0])
            got[0] += r[f"parts{i}"]
            got[1] += r[f"borders{i}"]
    return {name: Model({d: (a + 1) / (b + 2) for (n, d), (a, b) in sums.items() if n == name}, mass) for name, mass in masses.items()}


@dataclass
class Segmentation:
    """What is learned of some columns: their models, and the fields whose likeliest reading is not the usual one.

    ``odd`` (name, raw, separators) holds such fields, ``odd_hot`` those with a
    share of ``_HOT`` of all rows, by (name, raw).
    """

    models: dict[str, Model] = field(default_factory=dict)
    odd: DataFrame | None = None
    odd_hot: dict[tuple[str, str], str] = field(default_factory=dict)


def learn(fields: DataFrame, grammars: dict[str, Grammar], rounds: int = 2) -> Segmentation:
    """EM over all distinct fields of the columns in ``fields`` (name, raw), then Viterbi for each.

    ``rounds`` is the number of E- and M-steps before the decision.
    """
    distinct = fields.where(F.col("name").isin(list(grammars)) & F.col("raw").isNotNull()).groupBy("name", "raw").agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = stage(distinct.select(F.monotonically_increasing_id().alias("field_id"), "name", "raw", "n_rows"), "packed-distinct")
    spelling = {n: Spelling(g.delimiters) for n, g in grammars.items()}
    letters = spread(distinct.select("name", "raw")).mapInArrow(_letters, "name string, letter string, n bigint")
    for r in letters.groupBy("name", "letter").agg(F.sum("n").alias("n")).collect():
        spelling[r["name"]].shares[r["letter"]] = float(r["n"])
    for s in spelling.values():
        s.total = sum(s.shares.values())
    begun = stage(spread(distinct).mapInArrow(_begin(grammars, spelling), _FIELD), "packed-lattices")
    most = max(len(g.delimiters) for g in grammars.values())
    # fields of one reading count alike in all rounds
    closed = stage(_value_counts(begun.where("delimiters = ''")), "packed-single")
    fixed = _separations(begun.where("delimiters = '' and sure <> ''"), 1)
    now = begun.where("delimiters <> ''")
    n_rows, n_runs = begun.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    # a value that recurs in few fields is looked up by a join, one that would make a join uneven goes with the code
    floor = max(2.0, _HOT * n_runs)
    models: dict[str, Model] = {}
    for step in range(rounds + 1):
        counts = stage(closed.unionByName(_value_counts(now)).groupBy("name", "hash").agg(F.sum("n").alias("n"), F.sum("n_fields").alias("n_fields")), "packed-values")
        sums = counts.groupBy("name", F.when(F.col("n_fields") >= floor, F.col("hash")).alias("hot")).agg(F.sum("n").alias("n")).collect()
        hot = {r["hot"]: r["n"] for r in sums if r["hot"] is not None}
        masses: dict[str, float] = {}
        for r in sums:
            masses[r["name"]] = masses.get(r["name"], 0.0) + r["n"]
        models = _maximise([*fixed, *_separations(now, most)], masses)
        shared = counts.where((F.col("n_fields") > 1) & (F.col("n_fields") < floor)).select("hash", "n")
        wanted = now.select("field_id", F.explode("hashes").alias("hash")).where(f"hash not in ({', '.join(str(h) + 'L' for h in (_NO_VALUE, *hot))})")
        known = wanted.join(shared.hint("merge"), "hash").groupBy("field_id").agg(F.collect_list(F.struct("hash", "n")).alias("known"))
        decide = step == rounds
        met = now.join(known.hint("merge"), "field_id", "left").select(*now.columns, "known").mapInArrow(_expect(models, hot, decide), _DECISION if decide else _FIELD)
        now = stage(met, "packed-readings")
    heavy = F.col("n_rows") >= max(_HOT * n_rows, 1.0)
    odd_hot = {(r["name"], r["raw"]): r["separators"] for r in now.where(heavy).collect()}
    rest = now.where(~heavy).select("name", "raw", "separators")
    return Segmentation(models, None if rest.isEmpty() else rest, odd_hot)


def split_fields(fields: DataFrame, keys: Sequence[str], grammars: dict[str, Grammar], learned: Segmentation) -> DataFrame:
    """One row per value: the ``keys``, ``value_pos`` and ``value``. ``fields`` has the keys, ``name`` and ``raw``.

    Each field is read as Viterbi decided for it.
    """
    cutters = {n: _cutter(g) for n, g in grammars.items()}
    models, odd_hot = learned.models, learned.odd_hot
    schema = fields.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", value_pos int, value string"
    rows = fields.select(*keys, "name", "raw").where(F.col("name").isin(list(grammars)) & F.col("raw").isNotNull())
    rows = spread(rows) if learned.odd is None else rows.join(learned.odd, ["name", "raw"], "left")
    rows = rows.select(*keys, "name", "raw", F.col("separators") if learned.odd is not None else F.lit(None).cast("string").alias("separators"))
    nothing = Model()

    def values(name: str, raw: str, separators: str | None) -> list[str]:
        net = lattice(raw, grammars[name], cutters[name])
        if separators is None:
            separators = odd_hot.get((name, raw))
        if separators is None:
            separators = models.get(name, nothing).usual(net.open)
        return [v for v in net.values(separators) if v and not (grammars[name].pairs and "=" not in v)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            names, raws, chosen = [batch.column(n + i).to_pylist() for i in range(3)]
            met: dict[tuple, list[str]] = {}
            take, at, out = [], [], []
            for i, key in enumerate(zip(names, raws, chosen, strict=True)):
                found = met.get(key)
                if found is None:
                    found = met[key] = values(*key)
                take.extend([i] * len(found))
                at.extend(range(len(found)))
                out.extend(found)
            index = pa.array(take, pa.int64())
            kept = [batch.column(k).take(index) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array(out, pa.string())], names=[*keys, "value_pos", "value"])

    return rows.mapInArrow(run, ddl)


def _packed_of(headers: Column, names: Sequence[str]) -> Column:
    """(place, lower-case name, raw value) of the named headers; ragged pairs keep their place but hold nothing."""
    placed = F.transform(
        headers,
        lambda h, i: F.struct(i.alias("pos"), F.lower(F.try_element_at(h, F.lit(1))).alias("name"), F.try_element_at(h, F.lit(2)).alias("raw")),
    )
    return F.filter(placed, lambda x: x["name"].isin(list(names)) & x["raw"].isNotNull())


def packed_headers(entries: DataFrame) -> DataFrame:
    """Packed headers of each entry: entry_id, side, header_pos, name, raw."""
    kept = latest_entries(
        entries,
        {
            "request": _packed_of(F.col("request.headers"), list(REQUEST_HEADERS)),
            "response": _packed_of(F.col("response.headers"), list(RESPONSE_HEADERS)),
        },
    )
    none = F.array().cast("array<struct<pos:int,name:string,raw:string>>")

    def tagged(side: str) -> Column:
        return F.transform(F.coalesce(F.col(side), none), lambda x: F.struct(F.lit(side).alias("side"), x.alias("h")))

    sides = F.concat(tagged("request"), tagged("response"))
    return kept.select("entry_id", F.explode(sides).alias("x")).select(
        "entry_id", "x.side", F.col("x.h.pos").alias("header_pos"), F.col("x.h.name").alias("name"), F.col("x.h.raw").alias("raw")
    )


def header_values(entries: DataFrame) -> DataFrame:
    """Every value packed in a header: entry_id, side, header_pos, value_pos, value."""
    fields = stage(packed_headers(entries), "packed-headers")
    return split_fields(fields, ["entry_id", "side", "header_pos"], GRAMMARS, learn(fields, GRAMMARS))
