"""Shapes of the bodies of each endpoint cluster, whatever their format."""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bodies, headers, jsonkit, outlines
from ..functions.schemas import Shape
from ..sources.tables import latest_entries, stage
from .catalog import KEY, cluster_id
from .meta import META, with_meta

_MOST_GROUPS = 2_000


def kept_bodies(entries: DataFrame, target: str = "response", sample: int | None = None) -> DataFrame:
    """The members of each cluster that have a body, or the first ``sample`` of them: cluster_id, ts_ms, entry_id, content_type, body.

    The cut is pushed below the shuffle, so a large cluster sends ``sample``
    rows per task.
    """
    kept = latest_entries(
        entries,
        {
            **{k: META[k]() for k in KEY},
            "ts_ms": META["ts_ms"](),
            "content_type": headers.first_value(F.col(f"{target}.headers"), "content-type"),
            "body": F.expr(f"try_to_binary({target}.body, 'base64')"),
        },
    ).where("body is not null and octet_length(body) > 0")
    kept = kept.withColumn("cluster_id", cluster_id())
    if sample is not None:
        w = Window.partitionBy("cluster_id").orderBy("ts_ms", "entry_id")
        kept = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= sample)
    return kept.select("cluster_id", "ts_ms", "entry_id", "content_type", "body")


class Partial:
    """Shape of the bodies of one category so far. Partials merge in any order; what is "first" goes by ``order``."""

    def __init__(self, kind: str) -> None:
        self.kind, self.seen, self.n, self.content_type = kind, 0, 0, None
        self.shape, self.marks = Shape(), set()
        self.roots: dict[str, list] = {}
        self.title, self.tags, self.firsts, self.forms, self.truncated = None, Counter(), {}, Counter(), False
        self.columns: dict[tuple, outlines.CsvColumn] = {}
        self.rows, self.header = 0, None
        self.keys: dict[str, list] = {}

    def add(self, text: str, content_type: str, order: tuple) -> None:
        self.seen += 1
        self.content_type = min(filter(None, (self.content_type, (order, content_type))))
        try:
            if self.kind in ("json", "yaml"):
                one = Shape.of(jsonkit.parse_json(text) if self.kind == "json" else bodies.parse_yaml(text))
                if len(self.marks) < 2:
                    self.marks.add(xxhash.xxh64_intdigest(json.dumps(one.schema(required=False))))
                self.shape.merge(one)
            elif self.kind == "xml":
                outline = outlines.xml_outline(text)
                self._root(outline.name, [order, 1, outline])
            elif self.kind == "html":
                page = outlines.HtmlOutline.of(text)
                self.title = min(filter(None, (self.title, (order, page.title) if page.title else None)), default=None)
                self.tags.update(page.tags)
                self.forms.update(json.dumps(f) for f in page.forms)
                self.truncated |= page.truncated
                self._first({("id", k): (order, v) for k, v in page.ids.items()} | {("meta", k): (order, v) for k, v in page.meta.items()})
            elif self.kind == "csv":
                names, rows, header = outlines.csv_table(text)
                self.header = min(filter(None, (self.header, (order, header))))
                self.rows += len(rows)
                for i, name in enumerate(names):
                    column = self.columns.setdefault((name, names[:i].count(name)), outlines.CsvColumn((order, i)))
                    column.place = min(column.place, (order, i))
                    for k, row in enumerate(rows):
                        column.add(row[i].strip() if i < len(row) else "", (order, k))
            elif self.kind == "form":
                for k, v in bodies.parse_form(text).items():
                    self._key(k, 1, [(order, v[0])])
            else:
                return
        except (ValueError, IndexError):
            return
        self.n += 1

    def _root(self, name: str, new: list) -> None:
        old = self.roots.get(name)
        if old is None:
            self.roots[name] = new
        else:
            a, b = sorted((old, new), key=lambda x: x[0])
            self.roots[name] = [a[0], a[1] + b[1], a[2].merge(b[2])]

    def _first(self, found: dict) -> None:
        for k, v in found.items():
            self.firsts[k] = min(v, self.firsts.get(k, v))

    def _key(self, key: str, n: int, values: list) -> None:
        old = self.keys.get(key, [0, []])
        self.keys[key] = [old[0] + n, sorted(old[1] + values)[:3]]

    def merge(self, other: Partial) -> Partial:
        self.seen, self.n, self.rows = self.seen + other.seen, self.n + other.n, self.rows + other.rows
        for name in ("content_type", "title", "header"):
            setattr(self, name, min(filter(None, (getattr(self, name), getattr(other, name))), default=None))
        self.shape.merge(other.shape)
        self.marks |= other.marks
        for name, found in other.roots.items():
            self._root(name, found)
        self.tags.update(other.tags)
        self.forms.update(other.forms)
        self.truncated |= other.truncated
        self._first(other.firsts)
        for key, column in other.columns.items():
            self.columns[key] = self.columns[key].merge(column) if key in self.columns else column
        for key, (n, values) in other.keys.items():
            self._key(key, n, values)
        return self

    def dump(self) -> dict:
        """The shape; ``skipped`` with a reason where there is none."""
        kind, out = self.kind, {"content_category": self.kind}
        if kind not in ("json", "yaml", "xml", "html", "csv", "form"):
            return out | {"skipped": True, "skip_reason": f"{'binary' if kind == 'binary' else 'unsupported'} content type: {self.content_type[1]}"}
        if kind == "form":
            keys = [{"key": k, "frequency": round(n / self.seen, 6), "examples": [x for _, x in v]} for k, (n, v) in sorted(self.keys.items())]
            return out | ({"form_keys": keys, "sample_count": self.seen} if keys else {"skipped": True, "skip_reason": "no form keys found"})
        if not self.n:
            return out | {"skipped": True, "skip_reason": f"no valid {kind.upper()} samples found"}
        if kind in ("json", "yaml"):
            return out | {"schema": self.shape.schema(), "sample_count": self.n, "all_match": len(self.marks) == 1}
        if kind == "xml":
            # the root of most bodies, then the others
            found = [r[2] for r in sorted(self.roots.values(), key=lambda r: (-r[1], r[0]))]
            more = {"other_roots": [r.dump() for r in found[1:]]} if found[1:] else {}
            return out | {"root": found[0].dump(), "max_depth": max(r.depth() for r in found), "truncated": any(r.any_truncated() for r in found), "sample_count": self.n} | more
        if kind == "html":
            ids, meta = ({k: v for (what, k), (_, v) in sorted(self.firsts.items()) if what == w} for w in ("id", "meta"))
            forms = [json.loads(f) | {"count": n} for f, n in sorted(self.forms.items())]
            return out | {"title": self.title[1] if self.title else "", "tag_counts": dict(sorted(self.tags.items())), "element_ids": ids, "forms": forms, "meta_tags": meta, "truncated": self.truncated, "sample_count": self.n}
        columns = [c.dump(name) for (name, _), c in sorted(self.columns.items(), key=lambda x: (x[1].place, x[0]))]
        return out | {"columns": columns, "row_count": self.rows, "has_headers": self.header[1], "sample_count": self.n}


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], Partial] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], pa.string()) for i in range(2)] + [pa.array([pickle.dumps(p) for p in held.values()], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["cluster_id", "content_category", "state"])

    for batch in batches:
        for cluster, ts, entry, content_type, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            kind = bodies.category(content_type)
            held.setdefault((cluster, kind), Partial(kind)).add(raw.decode("utf-8", "replace"), content_type, (-1 if ts is None else ts, entry))
        if len(held) >= _MOST_GROUPS:
            yield flush()
    if held:
        yield flush()


def _shape(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = None
    for batch in batches:
        for state in batch.column(2).to_pylist():
            one = pickle.loads(state)
            whole = one if whole is None else whole.merge(one)
    made = whole.dump()
    yield pa.RecordBatch.from_pydict({
        "cluster_id": pa.array([key[0].as_py()], pa.string()), "content_category": pa.array([key[1].as_py()], pa.string()),
        "sample_count": pa.array([made.get("sample_count", 0)], pa.int32()), "shape": pa.array([json.dumps(made, ensure_ascii=True)], pa.string()),
    })


def body_shapes(entries: DataFrame, target: str = "response", sample: int | None = None) -> DataFrame:
    """Shape of the bodies of each cluster and content category; with ``sample`` of its first bodies only.

    Bodies without a content type count as the first type of their cluster.
    Each task reduces its bodies to one partial per cluster and category.
    """
    kept = stage(kept_bodies(entries, target, sample), "kept-bodies")
    typed = kept.where("content_type <> ''")
    first = typed.groupBy("cluster_id").agg(F.min_by("content_type", F.struct("ts_ms", "entry_id")).alias("content_type"))
    untyped = kept.where("coalesce(content_type, '') = ''").drop("content_type").join(first, "cluster_id", "left")
    named = untyped.select("cluster_id", "ts_ms", "entry_id", F.coalesce("content_type", F.lit("")).alias("content_type"), "body")
    parts = typed.unionByName(named).mapInArrow(_partials, "cluster_id string, content_category string, state binary")
    return parts.groupBy("cluster_id", "content_category").applyInArrow(_shape, "cluster_id string, content_category string, sample_count int, shape string")


def html_tag_counts(entries: DataFrame) -> DataFrame:
    """Tags of all HTML responses per cluster: n and the number of pages that have the tag."""
    kind = headers.first_value(F.col("response.headers"), "content-type")
    page = F.when(kind.rlike("(?i)^(text/html|application/xhtml)"), F.expr("try_to_binary(response.body, 'base64')"))
    flat = with_meta(entries.withColumn("_page", page), KEY, "_page").select("entry_id", "ingested_at", cluster_id().alias("cluster_id"), "_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if raw is None else [{"tag": jsonkit.clean(t), "n": n} for t, n in outlines.HtmlOutline.of(raw.decode("utf-8", "replace")).tags.items()] for raw in batch.column(3).to_pylist()]
            tags = pa.array(found, pa.list_(pa.struct([("tag", pa.string()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], tags], names=["entry_id", "ingested_at", "cluster_id", "tags"])

    # tags are counted before the latest delivery is chosen, so pages are not shuffled
    counted = flat.mapInArrow(run, f"entry_id string, ingested_at {dict(flat.dtypes)['ingested_at']}, cluster_id string, tags array<struct<tag:string,n:bigint>>")
    kept = latest_entries(counted, {"cluster_id": F.col("cluster_id"), "tags": F.col("tags")})
    return kept.select("cluster_id", F.explode("tags").alias("t")).groupBy("cluster_id", "t.tag").agg(F.sum("t.n").alias("n"), F.count(F.lit(1)).alias("n_pages"))
