"""Reading order, line grouping and box matching of a page's tokens.

These depend on the order in which boxes are met, so a page is one group of applyInPandas; pages are independent and a
page's tokens are bounded by paper. Boxes are arrays (x0, y0, x1, y1); orders are arrays of places.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.edits import similarity

#: Limits of columns, bands and tables.
COVERAGE, GUTTER_WIDTH, GUTTER_HEIGHTS, GUTTER_CENTRE = 0.05, 8.0, 0.3, (0.2, 0.8)
SIDE_TOKENS, SIDE_WIDTH, WIDE, BAND_HEIGHTS, BAND_PIXELS, DEPTH = 6, 0.3, 0.5, 2.5, 32.0, 16
GRID_WIDTH, GRID_TOKENS, GRID_COLUMNS, GRID_ROWS, GRID_CELLS = 0.2, 12, 4, 4, 4
COLUMN_HEIGHTS, ROW_HEIGHTS = 2.0, 1.5
DENSE_COLUMNS, DENSE_ROWS, DENSE_CELLS, DENSE_REGULAR = 3, 4, 3, 0.75
BOX = ["x0", "y0", "x1", "y1"]


def per_page(tokens: DataFrame, page: str, columns: list[str], order: list[str], one, schema: str) -> DataFrame:
    """one(columns of a page's rows in order: numbers as numpy arrays, others as Arrow's) for each page; it gives arrays of equal lengths, which become
    rows of schema after the page. Pages come one after another, many in a batch, so a small page costs no call of Spark,
    and those dealt already stay where they are."""
    kind = dict(tokens.dtypes)[page]
    place = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    rows = tokens.select(page, *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)), place.alias("_k"))
    names, types = [part.split()[0] for part in schema.split(", ")], [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def whole(batches):
        """Batches cut before the first row of a page, but for pages of more than a batch, which are put together."""
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            if len(starts) and (held or starts[-1]):
                head = [*held, batch.slice(0, starts[-1])]
                held = []
                yield pa.Table.from_batches(head).combine_chunks()
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for table in whole(batches):
            if not table.num_rows:
                continue
            table = table.to_batches()[0]
            starts = np.flatnonzero(table.column(table.num_columns - 1).to_numpy() == 1)
            ends = np.append(starts[1:], table.num_rows)
            own = [c.to_numpy(zero_copy_only=False) if pa.types.is_primitive(c.type) else c for c in (table.column(i + 1) for i in range(len(columns)))]
            found = [one(*(c[i:j] for c in own)) for i, j in zip(starts, ends)]
            key = table.column(0).take(pa.array(np.repeat(starts, [len(f[0]) for f in found])))
            parts = [[f[k] for f in found] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([key, *(pa.array([x for p in part for x in p], kind) if isinstance(part[0], list) else pa.array(np.concatenate(part), kind) for part, kind in zip(parts, types))], [page, *names])

    return rows.mapInArrow(run, f"{page} {kind}, {schema}")


class Page:
    """Boxes of a page with the share of digits in each token: an array, or a function that gives it if it is asked for."""

    def __init__(self, boxes: np.ndarray, digits):
        self.x0, self.y0, self.x1, self.y1 = boxes.astype(float).T
        self.cx, self.cy, self.w = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2, self.x1 - self.x0
        self.h, self._digits = np.maximum(1.0, self.y1 - self.y0), digits
        self.fired = {"splits": 0, "tables": 0, "dense_tables": 0}

    @property
    def digits(self) -> np.ndarray:
        if callable(self._digits):
            self._digits = self._digits()
        return self._digits

    def height(self, at: np.ndarray) -> float:
        return max(1.0, float(np.median(self.h[at])))

    def width(self, at: np.ndarray) -> float:
        return float(self.x1[at].max() - self.x0[at].min())

    def gutter(self, at: np.ndarray) -> float | None:
        """Centre of the widest gap between columns: a run of x that few boxes cover, not too near an edge."""
        lo, span = self.x0[at].min(), int(self.width(at))
        if span <= 0:
            return None
        a = (self.x0[at] - lo).astype(int)
        b = np.maximum(a + 1, (self.x1[at] - lo).astype(int))
        edge = np.zeros(span + 3, int)
        np.add.at(edge, a, 1)
        np.add.at(edge, np.minimum(b, span + 2), -1)
        clear = np.cumsum(edge)[: span + 2] <= max(1, int(COVERAGE * len(at)))
        turn = np.flatnonzero(np.diff(np.concatenate([[False], clear, [False]]).astype(int)))
        start, end = turn[::2], turn[1::2]
        centre = (start + end) / 2
        ok = (end - start >= max(GUTTER_WIDTH, GUTTER_HEIGHTS * self.height(at))) & (centre > GUTTER_CENTRE[0] * span) & (centre < GUTTER_CENTRE[1] * span)
        if not ok.any():
            return None
        best = np.flatnonzero(ok)[np.argmax((end - start)[ok])]
        return float(centre[best] + lo)

    def is_column(self, at: np.ndarray, whole: float) -> bool:
        side = self.width(at)
        return side >= SIDE_WIDTH * whole and side > 0 and float(np.median(self.w[at])) >= 0.4 * side

    def columns(self, at: np.ndarray) -> np.ndarray:
        """Number of the table column of each token: a new one where a centre is too far from its column's first."""
        order = np.argsort(self.cx[at], kind="stable")
        first, k, limit, found = -np.inf, -1, COLUMN_HEIGHTS * self.height(at), []
        for c in self.cx[at[order]].tolist():
            if c - first > limit:
                first, k = c, k + 1
            found.append(k)
        out = np.zeros(len(at), int)
        out[order] = found
        return out

    def bands(self, at: np.ndarray, gap: float, alone: np.ndarray | None = None, by_end: bool = False) -> np.ndarray:
        """Number of the band of each token: a new one after a vertical gap, and around tokens that stand alone."""
        order = np.lexsort((self.y1[at], self.y0[at])) if by_end else np.argsort(self.y0[at], kind="stable")
        k, reach, found = 0, None, []
        single = [False] * len(at) if alone is None else alone[order].tolist()
        for y0, y1, apart in zip(self.y0[at[order]].tolist(), self.y1[at[order]].tolist(), single):
            if apart:
                k, reach = k + (reach is not None), None
                found.append(k)
                k += 1
                continue
            if reach is not None and y0 - reach > gap:
                k, reach = k + 1, None
            if reach is None or y1 > reach:
                reach = y1
            found.append(k)
        out = np.zeros(len(at), int)
        out[order] = found
        return out

    def rows(self, at: np.ndarray, tolerance=None) -> np.ndarray:
        """Number of the row of each token: the first row whose middle is within the tolerance (half the larger height)."""
        order = np.argsort(self.cy[at], kind="stable")
        t = at[order]
        tallest = float(self.h[t].max()) if len(t) else 1.0
        n, live, found = 0, [], []  # live: rows that a later token, whose middle isn't higher, may still join
        before, row = None, None
        for cy, h, y0, y1 in zip(self.cy[t].tolist(), self.h[t].tolist(), self.y0[t].tolist(), self.y1[t].tolist()):
            if before == (y0, y1) and y1 >= y0:
                found.append(row)  # the same box again: no row before took it, and its own one has it within
                continue
            before, row, gone = (y0, y1), None, False
            for span in live:
                off, own = cy - span[3], max(1.0, span[2] - span[1])
                if abs(off) <= 0.5 * (max(h, own) if tolerance is None else tolerance):
                    row = span[0]
                    span[1], span[2] = min(span[1], y0), max(span[2], y1)
                    span[3] = (span[1] + span[2]) / 2
                    break
                gone = gone or off > 0.5 * (max(tallest, own) if tolerance is None else tolerance)
            if gone:
                live = [s for s in live if cy - s[3] <= 0.5 * (max(tallest, 1.0, s[2] - s[1]) if tolerance is None else tolerance)]
            if row is None:
                row, n = n, n + 1
                live.append([row, y0, y1, (y0 + y1) / 2])
            found.append(row)
        out = np.zeros(len(at), int)
        out[order] = found
        return out

    def table(self, at: np.ndarray) -> np.ndarray | None:
        """Order of a table's cells, or of a dense table's rows, if the region is one."""
        if len(at) < GRID_TOKENS or self.width(at) <= 0 or np.median(self.w[at]) > GRID_WIDTH * self.width(at):
            return None
        col = self.columns(at)
        cells = lambda row: np.unique(np.unique(row * (col.max() + 1) + col) // (col.max() + 1), return_counts=True)[1]
        row = self.bands(at, ROW_HEIGHTS * self.height(at))
        n = cells(row)
        if col.max() + 1 >= GRID_COLUMNS and len(n) >= GRID_ROWS and np.median(n) >= GRID_CELLS:
            self.fired["tables"] += 1
            return at[np.lexsort((self.x0[at], self.y0[at], col, row))]
        row = self.rows(at, self.height(at))
        n = cells(row)
        if col.max() + 1 >= DENSE_COLUMNS and len(n) >= DENSE_ROWS and np.median(n) >= DENSE_CELLS and (n >= DENSE_CELLS).mean() >= DENSE_REGULAR:
            self.fired["dense_tables"] += 1
            return at[np.lexsort((self.y0[at], self.x0[at], row))]
        return None

    def region(self, at: np.ndarray, depth: int = 0) -> np.ndarray:
        """Order of a region: two columns if there are, else its bands each by itself, else a table, else as it is."""
        if len(at) <= 1 or depth >= DEPTH:
            return at
        middle = self.gutter(at)
        if middle is not None:
            left, right = at[self.cx[at] < middle], at[self.cx[at] >= middle]
            whole = self.width(at)
            fit = min(len(left), len(right)) >= SIDE_TOKENS and np.std(self.x1[right]) >= 0.5 * np.std(self.x0[right]) and (self.digits[right] >= 0.4).mean() < 0.5
            if fit and self.is_column(left, whole) and self.is_column(right, whole):
                self.fired["splits"] += 1
                return np.concatenate([self.region(left, 1), self.region(right, 1)])
        # boxes that share more than a pixel of height with a token: those that begin above its end less those that end before
        y0, y1 = self.y0[at], self.y1[at]
        beside = np.searchsorted(np.sort(y0), y1 - 1) - np.searchsorted(np.sort(y1), y0 + 1, side="right") - (y1 - y0 > 1)
        alone = (self.w[at] >= WIDE * self.width(at)) & (beside <= 0) & (self.width(at) > 0)
        if alone.sum() >= 0.5 * len(at):
            alone[:] = False
        band = self.bands(at, max(BAND_HEIGHTS * self.height(at), BAND_PIXELS), alone, True)
        parts = np.unique(band)
        if len(parts) <= 1:
            found = self.table(at)
            return at if found is None else found
        order = np.lexsort((self.y1[at], self.y0[at]))
        return np.concatenate([self.region(at[order[band[order] == k]], depth + 1) for k in parts])

    def reading_order(self) -> np.ndarray:
        at = np.arange(len(self.x0))
        out = self.region(at) if len(at) else at
        return out if any(self.fired.values()) else at


def reading_order(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """tokens with read_pos: their place in human reading order; the given order where no column or table is certain."""

    def digits(texts: pa.Array) -> np.ndarray:
        solid = [[c for c in t if not c.isspace()] for t in texts.to_pylist()]
        return np.array([sum(c.isdigit() for c in cs) / len(cs) if cs else 0.0 for cs in solid], float)

    def one(pos, text, *box):
        order = Page(np.stack(box, 1), lambda: digits(text)).reading_order()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pos, place

    return per_page(tokens, page, ["pos", "text", *BOX], ["pos"], one, f"pos {dict(tokens.dtypes)['pos']}, read_pos long")


def row_major(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    def one(pos, *box):
        p = Page(np.stack(box, 1), np.zeros(len(pos)))
        order = np.lexsort((p.y0, p.x0, p.rows(np.arange(len(pos)))))
        return pos[order], np.arange(len(pos))

    return per_page(tokens, page, ["pos", *BOX], ["pos"], one, f"pos {dict(tokens.dtypes)['pos']}, read_pos long")


def gutters(tokens: DataFrame, page: str = "doc_id") -> DataFrame:
    """Clear runs of x per page by a sweep over box edges, natively: (page, start, end) where at most max(1, 5 %) of the
    boxes lie. Edges are added up per x first."""
    n = tokens.groupBy(page).agg(F.count("*").alias("n"))
    edges = tokens.select(page, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.greatest("x1", F.col("x0") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    sums = edges.groupBy(page, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(page).orderBy("x")
    cover = sums.withColumns({"cover": F.sum("d").over(w), "next": F.lead("x").over(w)}).join(n, page).where("next is not null")
    cover = cover.withColumn("clear", F.col("cover") <= F.greatest(F.lit(1), F.floor(F.col("n") * COVERAGE)))
    new = F.when(F.col("clear") & ~F.coalesce(F.lag("clear").over(w), F.lit(False)), 1).otherwise(0)
    run = cover.withColumn("run", F.sum(new).over(w)).where("clear")
    return run.groupBy(page, "run").agg(F.min("x").alias("start"), F.max("next").alias("end")).drop("run")


def merge_lines(tokens: DataFrame, gap: float = 0.75, overlap: float = 0.5, page: str = "doc_id") -> DataFrame:
    """Text lines of token boxes: each token joins the first line that it overlaps vertically and that ends near it.
    (page, line, x0..y1, places)."""

    def one(pos, *box):
        lines, live = [], []  # live: lines that end low enough for this token, and so for one that begins further down
        for place, x0, y0, x1, y1 in zip(pos.tolist(), *(b.tolist() for b in box)):
            own, found, gone = max(1, y1 - y0), None, False
            for line in live:
                if line[3] - y0 < overlap:
                    gone = True
                    continue
                tall = min(own, max(1, line[3] - line[1]))
                if min(line[3], y1) - y0 >= overlap * tall and max(0, x0 - line[2]) <= gap * tall:
                    found = line
                    break
            if gone:
                live = [s for s in live if s[3] - y0 >= overlap]
            if found is None:
                found = [x0, y0, x1, y1, []]
                lines.append(found)
                live.append(found)
            else:
                found[:4] = min(found[0], x0), min(found[1], y0), max(found[2], x1), max(found[3], y1)
            found[4].append(place)
        lines.sort(key=lambda s: (s[1], s[0]))
        return (np.arange(len(lines)), *(np.array([s[k] for s in lines], np.int32) for k in range(4)), [s[4] for s in lines])

    return per_page(tokens, page, ["pos", *BOX], ["y0", "x0", "pos"], one, "line long, x0 int, y0 int, x1 int, y1 int, places array<long>")


def iou_pairs(a: DataFrame, b: DataFrame, least: float = 0.5, page: str = "page", cell: int = 128) -> DataFrame:
    """Pairs of boxes a(page, ai, ax0..ay1) and b(page, bi, bx0..by1) with intersection over union of at least so much.
    They meet through the cells of a grid, each pair in the first cell that both touch."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = lambda df, p: df.withColumn("i", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("j", F.explode(span(f"{p}y0", f"{p}y1")))
    c = F.col
    met = cells(a, "a").join(cells(b, "b"), [page, "i", "j"]).where((c("i") == F.floor(F.greatest("ax0", "bx0") / cell)) & (c("j") == F.floor(F.greatest("ay0", "by0") / cell)))
    iw, ih = (F.greatest(F.lit(0), F.least(f"a{k}1", f"b{k}1") - F.greatest(f"a{k}0", f"b{k}0")) for k in "xy")
    area = lambda p: F.greatest(F.lit(0), c(f"{p}x1") - c(f"{p}x0")) * F.greatest(F.lit(0), c(f"{p}y1") - c(f"{p}y0"))
    inter = iw * ih
    return met.withColumn("iou", F.when(inter > 0, inter / (area("a") + area("b") - inter)).otherwise(0.0)).where(c("iou") >= least).select(page, "ai", "bi", "iou")


def greedy_match(pairs: DataFrame, page: str = "page") -> DataFrame:
    """One-to-one matches by falling overlap; ties in order of (ai, bi)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iou", "ai", "bi"], ascending=[False, True, True])
        seen_a, seen_b, keep = set(), set(), []
        for a, b in zip(pdf.ai, pdf.bi):
            free = a not in seen_a and b not in seen_b
            keep.append(free)
            if free:
                seen_a.add(a)
                seen_b.add(b)
        return pdf[np.array(keep, bool)]

    return pairs.groupBy(page).applyInPandas(one, pairs.schema)


def box_report(a: DataFrame, b: DataFrame, matches: DataFrame, page: str = "page") -> DataFrame:
    """Per page: boxes, matches, share of a matched, share of b left over, mean overlap. Null without boxes."""
    n = lambda df, name: df.groupBy(page).agg(F.count("*").alias(name))
    m = matches.groupBy(page).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    out = n(a, "gt_total").join(n(b, "hyp_total"), page, "full").join(m, page, "left").fillna(0, ["gt_total", "hyp_total", "matched"])
    share = lambda x, y: F.when(F.col(y) > 0, x / F.col(y))
    return out.withColumns({"coverage": share(F.col("matched"), "gt_total"), "extra_rate": share(F.col("hyp_total") - F.col("matched"), "hyp_total")})


def align_lines(a: list[str], b: list[str], least: float = 0.6) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity) of two readings' lines, in order and without crossing, of the largest total similarity."""
    sim = np.array([[similarity(x, y) for y in b] for x in a]).reshape(len(a), len(b))
    gain = np.where(sim >= least, sim, -np.inf)
    best = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + gain[i]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if gain[i - 1, j - 1] > 0 and abs(best[i, j] - best[i - 1, j - 1] - gain[i - 1, j - 1]) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j, float(sim[i, j])))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(pages: DataFrame, page: str, a: str, b: str) -> DataFrame:
    """Alignment of two arrays of lines per page: (page, i, j, similarity)."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for pdf in batches:
            rows = [(p, *t) for p, x, y in zip(pdf[page], pdf[a], pdf[b]) for t in align_lines(list(x), list(y))]
            yield pd.DataFrame(rows, columns=[page, "i", "j", "similarity"])

    return pages.select(page, a, b).mapInPandas(run, f"{page} {kinds[page]}, i long, j long, similarity double")


def x_clusters(tokens: DataFrame, least: int = 4, page: str = "doc_id") -> DataFrame:
    """Vertical clusters: each token, left to right, joins the first cluster that it shares half the narrower width with;
    clusters of fewer than least tokens are left out. (page, pos, cluster)."""

    def one(pos, left, right):
        n, live, out = 0, [], []  # live: clusters that end right of this token's begin; the others share nothing any more
        for x0, x1 in zip(left.tolist(), right.tolist()):
            k, gone = None, False
            for hull in live:
                if hull[2] <= x0:
                    gone = True
                elif (min(hull[2], x1) - x0) / max(1, min(x1 - x0, hull[2] - hull[1])) >= 0.5:
                    k = hull[0]
                    hull[2] = max(hull[2], x1)
                    break
            if gone:
                live = [h for h in live if h[2] > x0]
            if k is None:
                k, n = n, n + 1
                live.append([k, x0, x1])
            out.append(k)
        out = np.array(out, np.int64)
        keep = np.bincount(out)[out] >= least
        return pos[keep], out[keep]

    return per_page(tokens, page, ["pos", "x0", "x1"], ["x0", "y0", "pos"], one, f"pos {dict(tokens.dtypes)['pos']}, cluster long")


def date_majority(tokens: DataFrame, share: float = 0.7) -> DataFrame:
    """Tokens (page, cluster, pos, y, m) whose year, or else month, isn't that of at least so large a share of the dates
    of their cluster: with the expected value."""
    group = ["page", "cluster"]
    n = tokens.groupBy(*group).agg(F.count("y").alias("n"), F.mode("y").alias("top_y"), F.mode("m").alias("top_m"))
    rows = tokens.join(n, group)
    c = rows.groupBy(*group).agg(F.count(F.when(F.col("y") == F.col("top_y"), 1)).alias("ny"), F.count(F.when(F.col("m") == F.col("top_m"), 1)).alias("nm"))
    rows = rows.join(c, group).withColumns({"want_y": F.when(F.col("ny") >= share * F.col("n"), F.col("top_y")), "want_m": F.when(F.col("nm") >= share * F.col("n"), F.col("top_m"))})
    odd = F.when(F.col("y") != F.col("want_y"), "year").when(F.col("m") != F.col("want_m"), "month")
    return rows.withColumn("odd", odd).where("odd is not null").select(*group, "pos", "odd", F.when(F.col("odd") == "year", F.col("want_y")).otherwise(F.col("want_m")).alias("expected"))
