"""Placing things in order: rows of cards, bins, axes with breaks. A group is placed by one call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.session import keep


def first_fit(cards: list[tuple[float, float]], rows: int, gap: float = 0.0) -> list[int | None]:
    """The first row in which each card (left, width) meets no earlier card; none if all rows are taken."""
    taken: list[list[tuple[float, float]]] = [[] for _ in range(rows)]
    out: list[int | None] = []
    for left, width in cards:
        right = left + width
        row = next((i for i, t in enumerate(taken) if all(right + gap <= a or b + gap <= left for a, b in t)), None)
        if row is not None:
            taken[row].append((left, right))
        out.append(row)
    return out


def pack_rows(cards: DataFrame, group: str, rows: int = 8, gap: float = 4.0) -> DataFrame:
    """(id, row) of cards (id, left, width, importance) of each group, the most important first.

    A group is a page that is drawn, so it is bounded by its width, not by the corpus; more cards than
    fit get no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["importance", "id"], ascending=[False, True])
        return pd.DataFrame({"id": pdf["id"], "row": pd.array(first_fit(list(zip(pdf["left"], pdf["width"])), rows, gap), "Int32")})

    return cards.select(group, "id", "left", "width", "importance").groupBy(group).applyInPandas(run, "id long, row int")


def next_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size in order; a bin is closed by the first size that it can't take."""
    bin_, held, out = 0, 0, []
    for n in sizes:
        if held and held + n > capacity:
            bin_, held = bin_ + 1, 0
        out.append(bin_)
        held += n
    return out


# Pixels of a card, of a break and of the stretch that is cut out, and left of the first card.
CARD, BREAK, CUT, LEFT = 168.0, 46.0, 520.0, 90.0
PAD = CARD / 2 + 10


def axis_segments(points: DataFrame, group: str, at: str, px: float) -> DataFrame:
    """(group, segments) of points (group, year): stretches of years without a gap that is wider than a card and CUT pixels at px a year, as
    a sorted array of (y0, y1, px0, px1), laid end to end with half a card at either side and a break between.

    Years are summed up first, so a hot group is its distinct years.
    """
    years = points.where(F.col(at).isNotNull()).select(group, F.col(at).cast("double").alias("y")).distinct()
    w = Window.partitionBy(group).orderBy("y")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > (CUT + CARD) / px).cast("int"), F.lit(0))
    runs = years.withColumn("_n", new).withColumn("_s", F.sum("_n").over(w)).groupBy(group, "_s").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    before = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    x = LEFT + PAD + F.coalesce(F.sum((F.col("y1") - F.col("y0")) * px + 2 * PAD + BREAK).over(before), F.lit(0.0))
    placed = runs.withColumn("px0", x).withColumn("px1", F.col("px0") + (F.col("y1") - F.col("y0")) * px)
    return placed.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("y0", "y1", "px0", "px1"))).alias("segments"))


def _last_from(segments: Column, field: str, value: Column) -> Column:
    """The place of the last segment whose field is at most value, -1 without one, by binary search."""

    powers = F.array(*[F.lit(1 << k) for k in range(24)])

    def step(at, k):
        ahead = at + F.element_at(powers, k + 1)
        return F.when((ahead < F.size(segments)) & (F.get(segments, ahead)[field] <= value), ahead).otherwise(at)

    return F.aggregate(F.array(*[F.lit(k) for k in reversed(range(24))]), F.lit(-1), step)


def _segment(segments: Column, field: str, value: Column, read) -> Column:
    """read(segment, whether value is before the first, whether it is the last), with the segment found once."""
    found = F.array(_last_from(segments, field, value))
    return F.transform(found, lambda i: read(F.get(segments, F.greatest(i, F.lit(0))), i < 0, i == F.size(segments) - 1))[0]


def axis_x(segments: Column, year: Column, px: float) -> Column:
    """The pixel of a year: in proportion within a segment and beyond the ends, in the break's middle for years that are cut out."""
    def read(s, early, last):
        return F.when(early | last | (year <= s["y1"]), s["px0"] + (year - s["y0"]) * px).otherwise(s["px1"] + PAD / 2)

    return F.when(F.size(segments) > 0, _segment(segments, "y0", year, read))


def axis_year(segments: Column, x: Column, px: float) -> Column:
    """The year of a pixel; what is no year of a segment is the end of the one before it."""
    def read(s, early, last):
        return F.when(early | last | (x <= s["px1"]), s["y0"] + (x - s["px0"]) / px).otherwise(s["y1"])

    return F.when(F.size(segments) > 0, _segment(segments, "px0", x, read))


def axis_stops(axes: DataFrame, group: str, step: float, px: float) -> DataFrame:
    """(group, year, x, edge) of the stops of axes (group, segments): multiples of step up to half a step, and a year, beyond a segment's end, or its
    beginning if it has none."""
    s = axes.select(group, F.explode("segments").alias("s"))
    lo, hi = F.ceil(F.col("s.y0") / step), F.floor(F.least(F.col("s.y1") + step * 0.5, F.col("s.y1") + 1) / step)
    years = F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: F.struct((k * step).alias("year"), F.lit(False).alias("edge")))).otherwise(F.array(F.struct(F.col("s.y0").alias("year"), F.lit(True).alias("edge"))))
    return s.withColumn("t", F.explode(years)).select(group, F.col("t.year").alias("year"), (F.col("s.px0") + (F.col("t.year") - F.col("s.y0")) * px).alias("x"), F.col("t.edge").alias("edge"))


class _Taken:
    """Which rows hold something over a stretch, a bit a row, in a tree over all ends of stretches: what is put in or asked for takes steps by the
    logarithm of their number. Stretches that only touch don't meet; one without width meets those that it lies inside."""

    def __init__(self, ends):
        self.at = {x: 2 * i for i, x in enumerate(sorted(set(ends)))}  # even places are ends, odd ones lie between
        self.n = max(1, 2 * len(self.at))
        self.wide, self.points = ([0] * (2 * self.n), [0] * (2 * self.n)), ([0] * (2 * self.n), [0] * (2 * self.n))

    def _nodes(self, a, b):
        i, j = self.at[a], self.at[b]
        lo, hi = (i + self.n, j + self.n + 1) if i == j else (i + 1 + self.n, j + self.n)
        while lo < hi:
            if lo & 1:
                yield lo
                lo += 1
            if hi & 1:
                hi -= 1
                yield hi
            lo, hi = lo >> 1, hi >> 1

    def put(self, a, b, rows: int) -> None:
        whole, some = self.points if a == b else self.wide
        for v in self._nodes(a, b):
            whole[v] |= rows
            while v:
                some[v] |= rows
                v >>= 1

    def met(self, a, b) -> int:
        out = 0
        for whole, some in (self.wide,) if a == b else (self.wide, self.points):
            for v in self._nodes(a, b):
                out |= some[v]
                while v := v >> 1:
                    out |= whole[v]
        return out


def pack_cards(cards: list[dict], rows: int | None = None, optional: list[dict] = (), pad: float = 4.0) -> dict:
    """{id: row} of cards (id, left, right, height in rows, line: a stretch above it or None), in the order given: each in the first row
    where all its rows are free and its line crosses neither another line nor the inside of a taller card. Optional cards come
    last, within `rows` rows, or not at all."""
    every = [*cards, *optional]
    lined = [(c["line"][0] - pad, *c["line"], c["line"][1] + pad) for c in every if c.get("line")]
    taken, lines = _Taken(x for c in every for x in (c["left"], c["right"])), _Taken(x for xs in ([(c["left"], c["right"]) for c in every] + lined if lined else ()) for x in xs)
    out: dict = {}

    def place(c, last):
        (a, b), h, line = (c["left"], c["right"]), c["height"], c.get("line")
        held = taken.met(a, b)
        blocked = 0
        for k in range(h):
            blocked |= held >> k
        if lined:
            over = lines.met(a, b)
            for k in range(1, h):
                blocked |= over >> k
            if line:
                blocked |= lines.met(line[0] - pad, line[1] + pad)
        row = (~blocked & (blocked + 1)).bit_length() - 1  # the first bit that isn't set
        if last is not None and row + h > last:
            return
        taken.put(a, b, ((1 << h) - 1) << row)
        if lined:
            if h > 1:
                lines.put(a, b, ((1 << (h - 1)) - 1) << (row + 1))
            if line:
                lines.put(*line, 1 << row)
        out[c["id"]] = row

    for c in cards:
        place(c, None)
    for c in optional:
        place(c, rows)
    return out


def packed_cards(cards: DataFrame, group: str) -> DataFrame:
    """(group, id, row) of cards (group, id, left, right, height, importance), each group, a page that is drawn, the most important first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["importance", "id"], ascending=[False, True])
        found = pack_cards([{"id": i, "left": a, "right": b, "height": int(h), "line": None} for i, a, b, h in zip(pdf["id"], pdf["left"], pdf["right"], pdf["height"])])
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "row": pd.array([found[i] for i in pdf["id"]], "Int32")})

    kinds = dict(cards.dtypes)
    return cards.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, id {kinds['id']}, row int")


def pack_bars(bars: DataFrame, group: str, lo: str, hi: str, view: tuple[float, float], rows: int = 3, width: float = 1000.0, gap: float = 3.0, least: float = 6.0) -> DataFrame:
    """(group, id, row, x0, x1, clipped) of spans (id, lo, hi, is_key, importance) drawn in a view: key ones and the important first; spans over more
    than twice the view, all of it, are context and left out, as are stubs and what finds no row. A group is one page that is drawn."""
    a, b = view
    px = width / max(1e-9, b - a)
    umbrella = (F.col(lo) <= a) & (F.col(hi) >= b) & (F.col(hi) - F.col(lo) > 2 * (b - a))
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(width), (F.col(c) - a) * px))
    drawn = bars.where(~umbrella).select(group, "id", "is_key", "importance", F.col(lo).alias("_s"), at(lo).alias("x0"), at(hi).alias("x1"), ((F.col(lo) < a) | (F.col(hi) > b)).alias("clipped"))
    drawn = drawn.where(F.col("x1") - F.col("x0") >= least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_key", "importance", "_s", "id"], ascending=[False, False, True, True])
        pdf["row"] = pd.array(first_fit(list(zip(pdf["x0"], pdf["x1"] - pdf["x0"])), rows, gap), "Int32")
        return pdf[pdf["row"].notna()][[group, "id", "row", "x0", "x1", "clipped"]]

    kinds = dict(bars.dtypes)
    return drawn.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, id {kinds['id']}, row int, x0 double, x1 double, clipped boolean")


def lane_rows(marks: DataFrame, caps: dict[str, int], cell: float = 4.0) -> DataFrame:
    """(lane, kind, id, row) of marks (lane, kind, id, left, right, priority): each lane's kind has so many rows of cells; a mark takes the first
    row whose cells are all free, by priority, and none if there is no such row. A lane's marks are what one screen may show."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "id"], ascending=[False, True])
        used: list[int] = [0] * caps[pdf["kind"].iloc[0]]  # a bit a cell
        row = []
        for a, b in zip(pdf["left"], pdf["right"]):
            i, j = max(0, int(a // cell)), max(0, int(b // cell))
            mask = ((1 << (j - i + 1)) - 1) << i
            at = next((r for r, bits in enumerate(used) if not bits & mask), None)
            if at is not None:
                used[at] |= mask
            row.append(at)
        out = pdf[["lane", "kind", "id"]].copy()
        out["row"] = pd.array(row, "Int32")
        return out[out["row"].notna()]

    k = dict(marks.dtypes)
    return marks.groupBy("lane", "kind").applyInPandas(run, f"lane {k['lane']}, kind string, id {k['id']}, row int")


def lane_caps(z: int) -> dict[str, int]:
    """Rows of each kind, z doublings in from the whole range."""
    return {"spans": min(6, 2 + z // 2), "events": min(12, 2 + z), "people": min(8, 1 + int(z * 0.7)), "more": min(4, 1 + z // 3)}


def _one_tile(caps: dict[str, int], z: int):
    """Places one tile's marks: those of the coarser zoom in their rows, then by priority where bitmaps are free."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(new=pdf["row"].isna()).sort_values(["new", "priority", "id"], ascending=[True, False, True])
        used = [0] * caps[pdf["kind"].iloc[0]]  # a bit a cell
        rows, first = [], []
        for i, j, row, since in zip(pdf["i"], pdf["j"], pdf["row"], pdf["first"]):
            mask = ((1 << (int(j) - int(i) + 1)) - 1) << int(i)
            at = next((r for r, bits in enumerate(used) if not bits & mask), None) if pd.isna(row) else int(row)
            if at is not None:
                used[at] |= mask
            rows.append(at)
            first.append(z if pd.isna(since) else int(since))
        kept = pdf[["lane", "kind", "tile", "id"]].assign(row=pd.array(rows, "Int32"), first=pd.array(first, "Int32"))
        return kept[kept["row"].notna()]

    return run


def zoomed_lanes(marks: DataFrame, origin: float, px: float, levels: int, screen: int = 1024, cell: int = 4) -> DataFrame:
    """(z, lane, kind, tile, id, row, first): marks (lane, kind, id, start, end, label, priority) laid out at each of so many zooms.

    px are the pixels a unit of time of zoom 0, doubled with each zoom; a tile is one screen of a zoom. By priority a mark takes the first of its kind's
    rows whose cells are free in the tile, and what finds none waits for more zoom: each zoom begins with the marks that the one before placed in the
    tile's parent, in their rows, which there can't collide. first is the zoom at which a mark came in. A span over
    all of a tile that is longer than two is context and left out there. Of marks with the very same cells only as many as there are
    rows can ever be placed; the others are dropped in a top-k before a tile is gathered, so a tile holds at most rows times pairs of cells.
    """
    kinds = dict(marks.dtypes)
    schema = f"lane {kinds['lane']}, kind string, tile long, id {kinds['id']}, row int, first int"
    out, placed = [], None
    for z in range(levels):
        caps, scale = lane_caps(z), px * 2**z
        a = (F.col("start") - origin) * scale
        b = F.greatest((F.coalesce("end", "start") - origin) * scale, a)
        span = F.col("kind") == "spans"
        left = F.when(span, a - 3).when(b - a >= 8, a - 5).otherwise(a - 10)
        right = F.when(span, F.greatest(b, a + 6) + 3).when(b - a >= 8, F.greatest(b, a + 2 + F.col("label")) + 5).otherwise(a + 14 + F.col("label"))
        m = marks.select("lane", "kind", "id", "priority", left.alias("l"), right.alias("r"), span.alias("s")).where(F.col("r") >= 0)
        lo, hi = F.greatest(F.lit(0), F.floor(F.col("l") / screen)), F.floor(F.col("r") / screen)
        context = F.col("s") & (F.col("r") - F.col("l") > 2 * screen)
        tiles = F.when(context, F.array_distinct(F.array(lo, hi))).otherwise(F.sequence(lo, hi))
        m = m.withColumn("tile", F.explode(tiles))
        at = lambda c: F.greatest(F.lit(0), F.least(F.lit(screen // cell - 1), F.floor((F.col(c) - F.col("tile") * screen) / cell))).cast("int")
        m = m.select("lane", "kind", "tile", "id", "priority", at("l").alias("i"), at("r").alias("j"))
        if placed is None:
            m = m.withColumns({"row": F.lit(None).cast("int"), "first": F.lit(None).cast("int")})
        else:
            parents = placed.select("lane", "kind", F.col("tile").alias("_up"), "id", "row", "first")
            m = m.withColumn("_up", F.shiftright("tile", 1)).join(parents, ["lane", "kind", "_up", "id"], "left").drop("_up")
        cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind"))
        same = Window.partitionBy("lane", "kind", "tile", "i", "j").orderBy(F.col("row").isNull(), F.desc("priority"), "id")
        m = m.withColumn("_r", F.row_number().over(same)).where((F.col("_r") <= max(caps.values())) & (F.col("_r") <= cap)).drop("_r")

        placed = keep(m.groupBy("lane", "kind", "tile").applyInPandas(_one_tile(caps, z), schema))
        out.append(placed.select(F.lit(z).alias("z"), "*"))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return both


def stack_lanes(lanes: DataFrame, section: float = 22.0, label: float = 14.0, row: float = 18.0, gap: float = 6.0) -> DataFrame:
    """lanes (section, seq, rows, folded) with y, the top of each below all before it: a header a section, then a label, rows and a gap a lane."""
    from almanack.operators.ranking import running_totals

    first = F.row_number().over(Window.partitionBy("section").orderBy("seq")) == 1
    height = F.when(F.col("folded"), 0.0).otherwise(label + row * F.col("rows") + gap)
    l = lanes.withColumns({"_h": height, "_s": F.when(first, section).otherwise(0.0)}).withColumn("_t", F.col("_h") + F.col("_s"))
    return running_totals(l, "_t", F.asc("section"), F.asc("seq")).withColumn("y", F.col("before") + F.col("_s")).drop("_h", "_s", "_t", "n", "before")


def grid_cells(rows: DataFrame, x0: float, x1: float, size: int = 128) -> DataFrame:
    """(cell_x, cell_y, id, ...) of rows (id, start, end, y in [0, 1]): a row of the grid for each column that a span occupies."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((F.col(c) - x0) / (x1 - x0) * size))).cast("int")
    y = F.least(F.lit(size - 1), F.floor(F.col("y") * size)).cast("int")
    return rows.select("id", "start", "end", "y", y.alias("cell_y"), F.explode(F.sequence(at("start"), F.greatest(at("start"), at("end")))).alias("cell_x"))


def grid_query(cells: DataFrame, x0: float, x1: float, box: tuple[float, float, float, float], size: int = 128) -> DataFrame:
    """(id): rows that meet a box (from, to, low, high): only its cells are looked at, then the rows themselves, each once."""
    a, b, lo, hi = box
    at = lambda v: max(0, min(size - 1, int((v - x0) / (x1 - x0) * size // 1)))
    near = cells.where(F.col("cell_x").between(at(a), at(b)) & F.col("cell_y").between(int(lo * size), min(size - 1, int(hi * size))))
    return near.where((F.col("start") <= b) & (F.col("end") >= a) & F.col("y").between(lo, hi)).select("id").distinct()


def default_zoom(anchors: DataFrame, group: str, at: str, card: float = 180.0, share: float = 0.4) -> DataFrame:
    """(group, px): pixels a year at which the gap of that share of all gaps between neighbours holds a card."""
    from almanack.operators.ranking import at_ranks, middle

    gaps = anchors.withColumn("_g", F.col(at) - F.lag(at).over(Window.partitionBy(group).orderBy(at))).where("_g > 0")
    return at_ranks(gaps, group, "_g", gap=middle(share)).select(group, (card / F.col("gap")).alias("px"))


def track_of(kind: Column, start: Column, end: Column, open_ended: Column, dataset: Column) -> Column:
    """Where a span is drawn: a closed period in the eras' track, a ruler's in the reigns', else a card."""
    era = (kind == "period") & (end > start) & ~F.coalesce(open_ended, F.lit(False))
    return F.when(F.coalesce(era, F.lit(False)), "eras").when(F.coalesce((dataset == "leaders") & (end > start), F.lit(False)), "reigns").otherwise("cards")


def warp(y: Column, folded: list[tuple[float, float]], height: float, strip: float = 18.0, inverse: bool = False) -> Column:
    """y in [0, 1] with folded bands squeezed to strips of so many pixels, together 0.6 of the axis at most, and the rest stretched."""
    bands = sorted((max(0.0, a), min(1.0, b)) for a, b in folded if min(1.0, b) > max(0.0, a))
    if not bands:
        return y
    k, shut = len(bands), sum(b - a for a, b in bands)
    share, open_ = min(max(strip / max(1.0, height), 0.0), 0.6 / k), max(0.0, 1 - shut)
    each = share * open_ / (1 - share * k) if open_ > 1e-9 and share * k < 0.999 else 1.0
    cuts, at, to = [], 0.0, 0.0
    for a, b in bands:
        if a > at:
            cuts.append((at, a, to, to + a - at))
            to += a - at
        cuts.append((a, b, to, to + each))
        at, to = b, to + each
    if at < 1:
        cuts.append((at, 1.0, to, to + 1 - at))
    total = open_ + k * each
    out = F.lit(None).cast("double")
    for a, b, c, d in reversed(cuts):
        (x0, x1), (y0, y1) = ((c / total, d / total), (a, b)) if inverse else ((a, b), (c / total, d / total))
        out = F.when(y <= x1, F.lit(y0) + (y - x0) / max(x1 - x0, 1e-12) * (y1 - y0)).otherwise(out)
    return F.when(y <= 0, 0.0).when(y >= 1, 1.0).otherwise(out)
