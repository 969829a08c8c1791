"""Fragments of one or two reads beside breaks, counted where they meet.

Breaks and spans of fragments are dealt by cell, the breaks first; a task goes through a cell's
fragments batch by batch and labels those that meet a break with numpy.  A pair of a fragment and
a break is no row: what leaves a task is one row for each break of a cell, or for each fragment.

Fields must be known here; fragments with an unknown one are labelled read by read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reads as R
from ..params import Params
from . import skew
from .ranges import bin_of

# Width of a cell, and pairs that are looked at at once.
WIDTH = 8_192
PAIRS = 1 << 15
CELL = ("sample", "chrom", "bin")
COUNTS = ("split_norm", "norm_olap_bp", "span_norm", "split", "sc_bases")
SUMS = (*[f"{c}{e}" for e in (1, 2) for c in COUNTS], "pairs", "spanning", "anomalous")
# What is true of a fragment, by bit: of its two reads, that it has two, that the pair counts in
# whole windows, that the last read has a span of its own, and that both are on one chromosome.
BITS = ("a_reverse", "a_ok", "a_short", "b_reverse", "b_ok", "b_short", "two", "wide", "second", "same")
OFF, SPLIT_NORM, SPLIT, SPAN_NORM, SPAN_OTHER, OTHER, NONE = range(7)


def known(fields: tuple[str, ...]) -> Column:
    """Whether all that labels look at is known of a fragment with its limits."""
    all_of = F.col("min_ins").isNotNull() & F.col("max_ins").isNotNull()
    for name in fields:
        all_of &= F.col(f"a.{name}").isNotNull() & (F.col("b").isNull() | F.col(f"b.{name}").isNotNull())
    return all_of


def ends(svs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each end of an SV (open, so with positions and limits), in its cell."""
    plus = [F.when(F.col(f"dir{e}") == "+", e).otherwise(0) for e in (1, 2)]
    each = F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"chr{e}").alias("chrom"), F.col(f"pos{e}").cast("long").alias("at")) for e in (1, 2)])
    out = svs.select(
        "sample",
        "sv_id",
        *[F.xxhash64(f"chr{e}").alias(f"chr{e}") for e in (1, 2)],
        *[F.col(f"pos{e}").cast("long").alias(f"pos{e}") for e in (1, 2)],
        (plus[0] + plus[1]).alias("plus"),
        F.col("max_ins").cast("double").alias("max_ins"),
        F.inline(each),
    )
    return out.withColumn("bin", bin_of(F.col("at"), width))


def _read(name: str) -> list[Column]:
    """Fields of a read as whole numbers, zeros where there is none."""
    r = R.nested(F.col(name))
    fields = {"start": r("ref_start"), "end": r("ref_end"), "left": R.left_clip(r), "right": R.right_clip(r)}
    whole = [F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"{name}_{k}") for k, c in fields.items()]
    return [F.xxhash64(r("chrom")).alias(f"{name}_chrom"), *whole]


def _flags(held: dict[str, Column]) -> Column:
    total = F.lit(0)
    for bit, name in enumerate(BITS):
        total += F.when(F.coalesce(held[name], F.lit(False)), 1 << bit).otherwise(0)
    return total.alias("flags")


def spans(short: DataFrame, p: Params, whole: bool, name: bool, width: int = WIDTH) -> DataFrame:
    """One row for each cell that a span of a fragment touches: the places [lo, hi) at which a break
    may count it.

    A read is ordinary if it is whole and its insert is.  Labels other than off_break, of a
    fragment whose last read is ordinary (or has an ordinary insert, after an ordinary read),
    need a break within the threshold of the fragment's extent.  Two other reads may be a pair
    of left-over reads wherever both are in windows.  With ``whole`` the spans are all places
    in whose window a read may lie."""
    a, b = R.nested(F.col("a")), R.nested(F.col("b"))
    lo, hi, t = F.col("min_ins"), F.col("max_ins"), p.threshold
    ordinary = {k: ~R.clipped(r) & R.insert_between(r, lo, hi) for k, r in (("a", a), ("b", b))}
    two = F.col("b").isNotNull()
    close = F.coalesce(ordinary["b"] | (ordinary["a"] & R.insert_between(b, lo, hi)), F.lit(False))
    # one window may hold both
    near = F.coalesce((a("chrom") == b("chrom")) & (b("ref_start") - a("ref_end") <= 2 * hi + 2), F.lit(False))
    wide = two & ~close
    around = {k: (r("ref_start") - hi - 2, r("ref_end") + hi + 3) for k, r in (("a", a), ("b", b))}
    own = {k: (r("ref_start") - t, r("ref_end") + t + 1) for k, r in (("a", a), ("b", b))}
    hull = F.least(a("ref_start"), b("ref_start")) - t, F.greatest(a("ref_end"), b("ref_end")) + t + 1
    if whole:
        first, last, second = around["a"], around["b"], two
    else:
        first = [F.when(wide, x).when(two & near, y).otherwise(z) for x, y, z in zip(around["a"], hull, own["a"])]
        last, second = own["b"], two & (wide | ~near)

    def edges(at: Sequence[Column]) -> tuple[Column, Column]:
        return F.floor(at[0]).cast("long"), F.ceil(at[1]).cast("long")

    def span(i: int, chrom: Column, at: Sequence[Column]) -> Column:
        return F.struct(F.lit(i).alias("i"), chrom.alias("chrom"), *[c.alias(n) for n, c in zip(("lo", "hi"), edges(at))])

    flags = {"two": two, "wide": wide, "second": second, "same": a("chrom") == b("chrom")}
    for k, r in (("a", a), ("b", b)):
        flags |= {f"{k}_reverse": r("is_reverse"), f"{k}_ok": R.insert_between(r, lo, hi), f"{k}_short": F.abs(r("ins_len")) < hi}
    out = short.select(
        "sample",
        *(["query_name"] if name else []),
        _flags(flags),
        *[c.alias(f"first_{n}") for n, c in zip(("lo", "hi"), edges(first))],
        *_read("a"),
        *_read("b"),
        F.inline(F.filter(F.array(span(0, a("chrom"), first), F.when(second, span(1, b("chrom"), last))), lambda s: s.isNotNull())),
    )
    touched = F.sequence(bin_of(F.col("lo"), width), bin_of(F.col("hi") - 1, width))
    return out.filter("lo < hi").withColumn("bin", F.explode(touched))


@dataclass(frozen=True)
class Met:
    """Breaks and fragments dealt by cell, and how their pairs are looked at."""

    rows: DataFrame
    width: int
    p: Params

    def sums(self) -> DataFrame:
        """(sample, sv_id, *SUMS) for each end that counts anything in a cell."""
        return self._run(_by_sv(_add_sums, SUMS), "sv_id", T.LongType(), SUMS)

    def present(self) -> DataFrame:
        """(sample, sv_id, n): fragments in the windows of an SV, each added up once."""
        return self._run(_by_sv(_add_present, ("n",)), "sv_id", T.LongType(), ("n",))

    def told(self) -> DataFrame:
        """(sample, query_name, odd, supports) of fragments that are either, for each cell."""
        return self._run(_told, "query_name", T.BooleanType(), ("odd", "supports"))

    def _run(self, job: Callable, key: str, kind: T.DataType, names: tuple[str, ...]) -> DataFrame:
        given = [f for f in self.rows.schema.fields if f.name in ("sample", key)]
        schema = T.StructType([*sorted(given, key=lambda f: f.name != "sample"), *[T.StructField(n, kind) for n in names]])
        width, p, cell = self.width, self.p, [c for c in (*CELL, *skew.SALTS) if c in self.rows.columns]
        dealt = self.rows.repartition(*cell).sortWithinPartitions(*reversed(cell), F.col("flags").isNotNull(), "at")
        return dealt.mapInArrow(lambda batches: job(_cells(batches, cell, width), p), schema)


def deal(svs: DataFrame, short: DataFrame, p: Params, whole: bool = False, name: bool = False, task_rows: int = skew.TASK_ROWS, **_) -> Met:
    """Ends of SVs and spans of fragments (see ``spans``) in one table; a crowded cell is spread
    over tasks."""
    left, right, _keys = skew.salt_both(spans(short, p, whole, name), ends(svs), CELL, task_rows)
    return Met(left.unionByName(right, allowMissingColumns=True), WIDTH, p)


# ---------------------------------------------------------------- in a task


def _values(batch: pa.RecordBatch, skip: tuple[str, ...]) -> SimpleNamespace:
    return SimpleNamespace(**{n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in skip})


END = ("sample", "sv_id", "chr1", "chr2", "pos1", "pos2", "plus", "max_ins", "e", "at")


def _cells(batches: Iterator[pa.RecordBatch], cell: list[str], width: int):
    """For each batch: the breaks of its cells (those of the first cell may have come before), its
    fragments, for each the first and the last break of its span, how many breaks are of cells
    that go no further, and how many came before."""
    held, place = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, np.int64)
        for name in cell:
            column = batch.column(name)
            ids = (column.dictionary_encode().indices if pa.types.is_string(column.type) else column).to_numpy(zero_copy_only=False)
            differs[1:] |= ids[1:] != ids[:-1]
        at_cell = np.cumsum(differs)
        goes_on = place == tuple(batch.column(c)[0].as_py() for c in cell)
        is_fragment = batch.column("flags").is_valid()
        told = is_fragment.to_numpy(zero_copy_only=False)
        breaks = batch.select(list(END)).filter(pa.array(~told))
        of_break, before = at_cell[~told], 0
        if goes_on and held is not None:
            before = held.num_rows
            breaks = pa.concat_batches([held, breaks])
            of_break = np.concatenate([np.zeros(before, np.int64), of_break])
        rows = [c for c in batch.schema.names if c not in END or c == "sample"]
        fragments = batch.select(rows).filter(is_fragment)
        e, f = _values(breaks, ("sample", "sv_id")), _values(fragments, ("sample", "chrom", "query_name"))
        key, base = of_break * width + np.mod(e.at, width), at_cell[told] * width
        first, last = (np.searchsorted(key, base + np.clip(x - f.bin * width, 0, width)) for x in (f.lo, f.hi))
        done = int(np.searchsorted(of_break, at_cell[-1]))
        yield breaks, e, fragments, f, first, last, done, before
        held, place = breaks.slice(done), tuple(batch.column(c)[-1].as_py() for c in cell)


def _pairs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fragments and the breaks from ``first`` to ``last`` of each, some ``PAIRS`` at once."""
    upto = np.concatenate([[0], np.cumsum(np.maximum(last - first, 0))])
    total = upto[-1]
    for begin in range(0, total, PAIRS):
        nth = np.arange(begin, min(begin + PAIRS, total))
        fi = np.searchsorted(upto, nth, "right") - 1
        yield fi, first[fi] + nth - upto[fi]


def _of_pairs(f: SimpleNamespace, e: SimpleNamespace, fi: np.ndarray, ei: np.ndarray, p: Params) -> SimpleNamespace:
    """Fields of pairs: the reads ``a`` and ``b``, the ends 1 and 2, and which read lies in the
    window of which end."""
    flags = f.flags[fi]
    has = {name: (flags >> bit) & 1 == 1 for bit, name in enumerate(BITS)}
    v = SimpleNamespace(fi=fi, ei=ei, has=has, max_ins=e.max_ins[ei], met=e.e[ei], i=f.i[fi])
    for k in "ab":
        r = SimpleNamespace(**{n: getattr(f, f"{k}_{n}")[fi] for n in ("chrom", "start", "end", "left", "right")})
        r.reverse, r.ok, r.short = (has[f"{k}_{n}"] for n in ("reverse", "ok", "short"))
        r.there = has["two"] if k == "b" else np.ones(len(fi), bool)
        setattr(v, k, r)
    for n in (1, 2):
        pos = getattr(e, f"pos{n}")[ei]
        x = SimpleNamespace(chrom=getattr(e, f"chr{n}")[ei], pos=pos, plus=(e.plus[ei] & n) > 0)
        x.since = np.maximum(np.trunc(pos - v.max_ins), 0) - 1
        x.to = np.trunc(pos + v.max_ins)
        setattr(v, f"end{n}", x)
        for k in "ab":
            r = getattr(v, k)
            on = r.there & (r.chrom == x.chrom)
            setattr(v, f"on_{k}{n}", on)
            setattr(v, f"in_{k}{n}", on & (r.start < x.to) & (r.end > x.since))
    return v


def _first(v: SimpleNamespace, hits: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Whether a pair's span and end are the first of the four that hit, so that each SV and
    fragment meet once."""
    keep, earlier = np.zeros(len(v.fi), bool), np.zeros(len(v.fi), bool)
    for (i, n), hit in hits.items():
        keep |= (v.i == i) & (v.met == n) & ~earlier
        earlier |= hit
    return keep


def _bears(v: SimpleNamespace, f: SimpleNamespace, p: Params) -> np.ndarray:
    """Pairs to be labelled: a wide pair counts with both reads in windows, or near a break."""
    t, hits = p.threshold, {}
    lo, hi = f.first_lo[v.fi], f.first_hi[v.fi]
    bears = ~v.has["wide"] | v.in_b1 | v.in_b2
    for n in (1, 2):
        x, on = getattr(v, f"end{n}"), getattr(v, f"on_a{n}")
        bears |= on & (v.a.start - t <= x.pos) & (v.a.end + t >= x.pos)
        hits[0, n] = on & (lo <= x.pos) & (x.pos < hi)
    for n in (1, 2):
        x, on = getattr(v, f"end{n}"), getattr(v, f"on_b{n}")
        hits[1, n] = v.has["second"] & on & (v.b.start - t <= x.pos) & (x.pos <= v.b.end + t)
    return bears & _first(v, hits)


def _clipped(r: SimpleNamespace) -> np.ndarray:
    return (r.left != 0) | (r.right != 0)


def _below(r: SimpleNamespace, bases: int) -> np.ndarray:
    return (r.left < bases) & (r.right < bases)


def _covers(r: SimpleNamespace, pos: np.ndarray, slack: int) -> np.ndarray:
    return (r.start < pos + slack) & (r.end > pos - slack)


def _split(r: SimpleNamespace, pos: np.ndarray, clip: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a read is split at the break on its right, and on its left."""
    return (np.abs(r.end - pos) < t) & (r.right >= clip), (np.abs(r.start - pos) < t) & (r.left >= clip)


def _label(r: SimpleNamespace, x: SimpleNamespace, p: Params, mate: SimpleNamespace | None, same: np.ndarray, has_mate: np.ndarray) -> np.ndarray:
    """``counting.label_of`` for pairs; without ``mate`` the read is the last of its fragment."""
    t, pos = p.threshold, x.pos
    whole = ~_clipped(r)
    off = whole & r.ok & ~_covers(r, pos, t)
    across = _below(r, R.NORMAL_CLIP) & r.ok & _covers(r, pos, -p.norm_overlap)
    right, left = _split(r, pos, p.count_sc_len, t)
    label = np.full(len(pos), OTHER, np.int8)
    if mate is not None:
        pair = same & mate.ok & ~_covers(mate, pos, t) & ~((r.start < pos) & (mate.end > pos))
        off &= ~has_mate | pair
        spans = has_mate & whole & ~_clipped(mate) & (r.reverse != mate.reverse) & r.ok & (r.start < pos) & (mate.end > pos)
        mate_across = _below(mate, R.NORMAL_CLIP) & mate.ok & _covers(mate, pos, -p.norm_overlap)
        label[spans] = np.where(mate_across[spans], SPAN_OTHER, SPAN_NORM)
    split = r.short & np.where(r.left < t, right, left)
    directed = np.where(x.plus, right, left)
    label[split] = np.where(directed[split], SPLIT, OTHER)
    label[across] = SPLIT_NORM
    label[off] = OFF
    return label


def _chosen(r: SimpleNamespace, rows: np.ndarray) -> SimpleNamespace:
    return SimpleNamespace(**{n: x[rows] for n, x in vars(r).items()})


def _labels(v: SimpleNamespace, p: Params) -> dict[str, np.ndarray]:
    """Labels of both reads at both ends, NONE outside of the window and where the fragment was
    counted as normal before."""
    out = {}
    for n in (1, 2):
        for k, r, mate in (("a", v.a, v.b), ("b", v.b, None)):
            inside, x, same, has_mate = getattr(v, f"in_{k}{n}"), getattr(v, f"end{n}"), v.has["same"], getattr(v, f"in_b{n}")
            rows = np.flatnonzero(inside)
            if 2 * len(rows) < len(inside):
                # most pairs are far from one end of the SV
                label = np.full(len(inside), NONE, np.int8)
                label[rows] = _label(_chosen(r, rows), _chosen(x, rows), p, mate and _chosen(mate, rows), same[rows], has_mate[rows])
            else:
                label = np.where(inside, _label(r, x, p, mate, same, has_mate), NONE)
            out[f"{k}{n}"] = label
    normal = {k: (label == SPLIT_NORM) | (label == SPAN_NORM) for k, label in out.items()}
    at_end1 = normal["a1"] | normal["b1"]
    out["b1"] = np.where(normal["a1"], NONE, out["b1"])
    out["a2"] = np.where(at_end1, NONE, out["a2"])
    out["b2"] = np.where(at_end1 | normal["a2"], NONE, out["b2"])
    return out


def _lenient(r: SimpleNamespace, pos: np.ndarray, t: int) -> np.ndarray:
    right, left = _split(r, pos, t, t)
    return np.where(r.left < R.LENIENT_ANCHOR, right, left)


def _spans(v: SimpleNamespace, rows: np.ndarray, p: Params) -> np.ndarray:
    """Whether the two left-over reads of pairs ``rows`` support the junction."""
    a, b, end1, end2, most, t = _chosen(v.a, rows), _chosen(v.b, rows), _chosen(v.end1, rows), _chosen(v.end2, rows), v.max_ins[rows], p.threshold
    same = end1.chrom == end2.chrom
    turned = np.where(same, end1.pos > end2.pos, a.chrom == end2.chrom)
    one, two = (SimpleNamespace(**{n: np.where(turned, getattr(y, n), z) for n, z in vars(x).items()}) for x, y in ((a, b), (b, a)))
    gap = np.where(one.start < two.start, two.start - one.end, one.start - two.end)
    ordinary = (one.chrom == two.chrom) & (gap < most)
    d1, d2 = (np.where(r.reverse, r.end - x.pos, x.pos - r.start) for r, x in ((one, end1), (two, end2)))
    found = ~ordinary & (d1 > 0) & (d2 > 0) & (np.abs(d1) + np.abs(d2) < most)
    clips = np.where(_lenient(one, end1.pos, t), _below(two, t), ~_lenient(two, end2.pos, t) | _below(one, t))
    for r, x in ((one, end1), (two, end2)):
        found &= np.where(x.plus, (r.start < x.pos) & ~r.reverse, (r.end > x.pos) & r.reverse)
    return found & clips


def _labelled(f: SimpleNamespace, e: SimpleNamespace, first: np.ndarray, last: np.ndarray, p: Params):
    """Pairs that count, their labels, which of them are pairs of left-over reads, and which of
    these support the junction."""
    wide = (f.flags >> BITS.index("wide")) & 1 == 1 if len(first) else np.zeros(0, bool)
    # most pairs of a wide fragment do not bear on the break, and few of another do not
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for nth, ei in _pairs(first[rows], last[rows]):
            fi = rows[nth]
            v = _of_pairs(f, e, fi, ei, p)
            kept = _bears(v, f, p)
            some = 2 * kept.sum() < len(kept)
            if some:
                v, kept = _of_pairs(f, e, fi[kept], ei[kept], p), None
            labels = _labels(v, p)
            if not some:
                labels = {k: np.where(kept, label, NONE) for k, label in labels.items()}
            paired = ((labels["a1"] == OTHER) | (labels["a2"] == OTHER)) & ((labels["b1"] == OTHER) | (labels["b2"] == OTHER))
            paired = np.flatnonzero(paired)
            yield v, labels, paired, _spans(v, paired, p)


def _add_sums(f: SimpleNamespace, e: SimpleNamespace, first: np.ndarray, last: np.ndarray, p: Params, sums: np.ndarray) -> None:
    nth = {name: k for k, name in enumerate(SUMS)}

    def add(name: str, ei: np.ndarray, values: np.ndarray | None = None) -> None:
        if len(ei):
            sums[nth[name]] += np.bincount(ei, values, sums.shape[1]).astype(np.int64)

    for v, labels, paired, spans in _labelled(f, e, first, last, p):
        for n in (1, 2):
            pos = getattr(v, f"end{n}").pos
            for k in "ab":
                r, label = getattr(v, k), labels[f"{k}{n}"]
                across, split = np.flatnonzero(label == SPLIT_NORM), np.flatnonzero(label == SPLIT)
                add(f"split_norm{n}", v.ei[across])
                add(f"norm_olap_bp{n}", v.ei[across], np.minimum(np.abs(r.start - pos), np.abs(r.end - pos))[across])
                add(f"span_norm{n}", v.ei[label == SPAN_NORM])
                add(f"split{n}", v.ei[split])
                add(f"sc_bases{n}", v.ei[split], np.where(r.left < p.threshold, r.right, r.left)[split])
        add("pairs", v.ei[paired])
        add("spanning", v.ei[paired[spans]])
        add("anomalous", v.ei[paired[~spans]], np.full((~spans).sum(), 2))


def _add_present(f: SimpleNamespace, e: SimpleNamespace, first: np.ndarray, last: np.ndarray, p: Params, sums: np.ndarray) -> None:
    for fi, ei in _pairs(first, last):
        v = _of_pairs(f, e, fi, ei, p)
        hits = {(i, n): getattr(v, f"in_{k}{n}") for i, k in enumerate("ab") for n in (1, 2)}
        own = np.zeros(len(fi), bool)
        for (i, n), hit in hits.items():
            own |= (v.i == i) & (v.met == n) & hit
        sums[0] += np.bincount(ei[own & _first(v, hits)], minlength=sums.shape[1])


def _by_sv(add: Callable, names: tuple[str, ...]) -> Callable:
    """Sums of each break, given out when its cell is over."""

    def found(breaks: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero(sums.any(axis=0))
        keys = [breaks.column(c).take(pa.array(rows)) for c in ("sample", "sv_id")]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(x[rows]) for x in sums]], ["sample", "sv_id", *names])

    def run(cells, p: Params) -> Iterator[pa.RecordBatch]:
        breaks, carried = None, np.zeros((len(names), 0), np.int64)
        for now, e, _, f, first, last, done, before in cells:
            if breaks is not None and not before and carried.any():
                yield found(breaks, carried)
            sums = np.zeros((len(names), now.num_rows), np.int64)
            sums[:, :before] += carried[:, :before]
            add(f, e, first, last, p, sums)
            if sums[:, :done].any():
                yield found(now.slice(0, done), sums[:, :done])
            breaks, carried = now.slice(done), sums[:, done:]
        if carried.any():
            yield found(breaks, carried)

    return run


def _told(cells, p: Params) -> Iterator[pa.RecordBatch]:
    """Fragments that are a pair against a junction, or support one, by the breaks of a cell."""
    for _, e, fragments, f, first, last, _, _ in cells:
        odd, supports = (np.zeros(fragments.num_rows, bool) for _ in range(2))
        for v, labels, paired, spans in _labelled(f, e, first, last, p):
            odd[v.fi[paired[~spans]]] = True
            supports[v.fi[paired[spans]]] = True
            split = np.zeros(len(v.fi), bool)
            for label in labels.values():
                split |= label == SPLIT
            supports[v.fi[split]] = True
        rows = np.flatnonzero(odd | supports)
        if len(rows):
            keys = [fragments.column(c).take(pa.array(rows)) for c in ("sample", "query_name")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(odd[rows]), pa.array(supports[rows])], ["sample", "query_name", "odd", "supports"])
