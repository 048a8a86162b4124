"""Streams with keyed state that ends: residency, levels, chunks and hand-off of tracks, draping by region.

A track's fixes wait in its state, by event time, until the watermark has passed
them, so fixes that come late or out of order count as if they had come in order.
Event-time timers set them free; another timer ends a track that has had no fix
for ``idle``: what it holds is given back as ``expire`` events (without a fix) and
all of its state goes. A fix after such a gap starts anew. Tiles, chunks and
vertices are entries of map states, so a batch reads and writes only those that
it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilefabric.functions.grid import RINGS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Tile = tuple[int, int]


def run(rows: DataFrame, key: list[str], processor: StatefulProcessor, schema: str, late: str, ts: str = "ts") -> DataFrame:
    """``processor`` over the keys of a stream whose event time is ``ts``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one with map states and timers
    return rows.withWatermark(ts, late).groupBy(*key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def millis(t) -> int:
    t = pd.Timestamp(t)
    return int((t.tz_localize("UTC") if t.tzinfo is None else t).timestamp() * 1000)


def entering(now: Tile, before: Tile | None, radius: int) -> Iterator[Tile]:
    """The tiles within ``radius`` of ``now`` that are not within it of ``before``: two strips, or all."""
    for i in range(now[0] - radius, now[0] + radius + 1):
        if before is None or abs(i - before[0]) > radius:
            yield from ((i, j) for j in range(now[1] - radius, now[1] + radius + 1))
        else:
            yield from ((i, j) for j in range(now[1] - radius, min(now[1] + radius, before[1] - radius - 1) + 1))
            yield from ((i, j) for j in range(max(now[1] - radius, before[1] + radius + 1), now[1] + radius + 1))


class Entries:
    """A map state's entries as one batch sees them: each is read once at most, and only changes are written."""

    def __init__(self, state):
        self.state, self.known, self.changed, self.all = state, {}, set(), False

    def get(self, key):
        if key not in self.known and not self.all:
            self.known[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.known.get(key)

    def put(self, key, value) -> None:
        self.known[key] = value
        self.changed.add(key)

    def whole(self) -> dict:
        if not self.all:
            self.known = {tuple(k): tuple(v) for k, v in self.state.iterator()} | self.known
            self.all = True
        return {k: v for k, v in self.known.items() if v is not None}

    def write(self) -> None:
        for key in self.changed:
            if self.known[key] is None:
                self.state.removeKey(key)
            else:
                self.state.updateValue(key, self.known[key])
        self.changed.clear()


class Track(StatefulProcessor):
    """Fixes in order of event time, and the end of idle tracks; ``maps`` and ``step`` say what a track holds.

    Inputs are (key, id, ts and the two numbers ``at``); ``kind`` may say what a row is.
    """

    schema = ""
    maps: dict[str, tuple[str, str]] = {}
    at, ident, kind = ("te", "tn"), "fix_id", None

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, id long", "kind string, a int, b int")
        # The last tile, a number that grows, when the track is idle for too long, and the earliest fix that waits.
        self.last = handle.getValueState("last", "e int, n int, number long, due long, head long")
        self.held = {k: handle.getMapState(k, *v) for k, v in self.maps.items()}

    def step(self, track: int, fix: int | None, kind: str | None, at: Tile, last: Tile | None, number: int) -> tuple[list[tuple], Tile | None, int]:
        """The events of one fix, the tile where the track is then, and the number."""
        raise NotImplementedError

    def ended(self, track: int) -> list[tuple]:
        """The events of a track that ends."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        e, n, number, due, head = self.last.get() if self.last.exists() else (None, None, 0, None, None)
        times = set()
        for pdf in rows:
            kinds = pdf[self.kind] if self.kind else ["fix"] * len(pdf)
            for ts, ident, kind, a, b in zip(pdf["ts"], pdf[self.ident], kinds, pdf[self.at[0]], pdf[self.at[1]], strict=True):
                at = millis(ts)
                self.waiting.updateValue((at, int(ident)), (kind, int(a), int(b)))
                times.add(at)
        for at in times:
            self.handle.registerTimer(at)
        self.last.update((e, n, number, due, min(times | ({head} if head is not None else set()))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        e, n, number, due, head = self.last.get()
        now = timerValues.getCurrentWatermarkInMs()
        track, out, last = key[0], [], None if e is None else (e, n)
        self.entries = {k: Entries(v) for k, v in self.held.items()}
        if head is not None and head <= now:
            queue = sorted((k, v) for k, v in self.waiting.iterator())
            for (ts, ident), (kind, a, b) in queue:
                if ts > now:
                    break
                self.waiting.removeKey((ts, ident))
                if due is not None and ts > due:
                    out += self.ended(track)
                    last, number = None, 0
                more, last, number = self.step(track, ident, kind, (a, b), last, number)
                out, due = out + more, ts + self.idle_ms
                self.handle.registerTimer(due + 1)
            left = [ts for (ts, _), _ in queue if ts > now]
            head = min(left) if left else None
        over = due is not None and now > due
        if over:
            out += self.ended(track)
        for entries in self.entries.values():
            entries.write()
        if over and head is None:
            self.last.clear()
        else:
            at = (None, None) if over or last is None else last
            self.last.update((*at, 0 if over else number, None if over else due, head))
        if out:
            yield pd.DataFrame(out, columns=names(self.schema)).astype({c: "Int64" for c in names(self.schema) if c in ("fix_id", "event_id", "old_res")})


class Residency(Track):
    """Tiles load within ``radius`` and go beyond ``radius + margin``; between the two they stay as they are."""

    schema = "track_id long, fix_id long, ei int, ni int, action string"
    maps = {"tiles": ("ei int, ni int", "loaded boolean")}

    def __init__(self, idle_ms: int, radius: int, margin: int):
        super().__init__(idle_ms)
        self.radius, self.margin = radius, margin

    def step(self, track, fix, kind, at, last, number):
        tiles, out = self.entries["tiles"], []
        if last is not None:
            for t in entering(last, at, self.radius + self.margin):  # what leaves the wider square
                if tiles.get(t):
                    tiles.put(t, None)
                    out.append((track, fix, *t, "unload"))
        for t in entering(at, last, self.radius):
            if not tiles.get(t):
                tiles.put(t, (True,))
                out.append((track, fix, *t, "load"))
        return out, at, number

    def ended(self, track):
        tiles = self.entries["tiles"]
        held = sorted(tiles.whole())
        for t in held:
            tiles.put(t, None)
        return [(track, None, *t, "expire") for t in held]


class Levels(Track):
    """Tiles whose level of detail changes with a move; all levels follow from the last tile."""

    schema = "track_id long, fix_id long, ei int, ni int, old_lod int, new_lod int, texture boolean"

    def __init__(self, idle_ms: int, radius: int):
        super().__init__(idle_ms)
        self.radius = radius
        self.rings = next(r for most, r in RINGS.items() if most is None or radius <= most)

    def level(self, tile: Tile, at: Tile) -> int:
        d = max(abs(tile[0] - at[0]), abs(tile[1] - at[1]))
        return next(level for reach, level in self.rings if reach is None or d <= reach)

    def step(self, track, fix, kind, at, last, number):
        out = []
        if last is not None and last != at:
            inside = lambda t, c: max(abs(t[0] - c[0]), abs(t[1] - c[1])) <= self.radius
            strips = {t for reach, _ in self.rings[:-1] for pair in ((at, last), (last, at)) for t in entering(*pair, reach)}
            pixels = lambda lod: 64 if lod >= 7 else 256 if lod >= 5 else 1024
            for t in sorted(t for t in strips if inside(t, at) and inside(t, last)):
                old, new = self.level(t, last), self.level(t, at)
                if old != new:
                    out.append((track, fix, *t, old, new, pixels(old) != pixels(new)))
        return out, at, number


class Generation(Track):
    """A number that grows only when the track comes to another tile."""

    schema = "track_id long, fix_id long, generation long"

    def step(self, track, fix, kind, at, last, number):
        number += at != last
        return [(track, fix, number)], at, number


class Resolutions(Track):
    """The samples of each chunk in reach, with the remembered ones; out of reach a chunk is forgotten."""

    schema = "track_id long, fix_id long, cei int, cni int, old_res int, new_res int"
    maps = {"chunks": ("cei int, cni int", "res int")}

    def __init__(self, idle_ms: int, far: int, span: int):
        super().__init__(idle_ms)
        self.far, self.span = far, span

    def step(self, track, fix, kind, at, last, number):
        if at == last:
            return [], at, number
        (e, n), far, span, chunks, out = at, self.far, self.span, self.entries["chunks"], []
        chunks.whole()
        seen = set()
        for i in range((e - far) // span, (e + far) // span + 1):
            for j in range((n - far) // span, (n + far) // span + 1):
                d = max(i * span - e, e - i * span - span + 1, j * span - n, n - j * span - span + 1, 0)
                if d <= far:
                    seen.add((i, j))
                    (old,) = chunks.get((i, j)) or (None,)
                    new = resolution(d, old)
                    if new != old:
                        chunks.put((i, j), (new,))
                        out.append((track, fix, i, j, old, new))
        for c in [c for c, v in chunks.known.items() if v is not None and c not in seen]:
            chunks.put(c, None)
        return out, at, number

    def ended(self, track):
        for c in self.entries["chunks"].whole():
            self.entries["chunks"].put(c, None)
        return []


def resolution(d: int, old: int | None) -> int:
    """Samples of a chunk at a distance; it gets coarser only four tiles past the border."""
    return 129 if d <= 32 + 4 * (old == 129) else 65 if d <= 64 + 4 * (old == 65) else 33


class Handoff(Track):
    """Loads and unloads of tiles and of the chunks beyond them, each waiting for the other.

    Both are held with 0 while they load and 1 once they are there (or known to
    have no data). A tile out of the radius stays while the chunk that will show
    its place is still loading. A chunk all of whose tiles are in the radius goes
    when they are all there.
    """

    schema = "track_id long, event_id long, kind string, a int, b int, action string"
    maps = {"tiles": ("a int, b int", "ready int"), "chunks": ("a int, b int", "ready int")}
    at, ident, kind = ("a", "b"), "event_id", "kind"

    def __init__(self, idle_ms: int, radius: int, margin: int, far: int, span: int):
        super().__init__(idle_ms)
        self.sizes = radius, margin, far, span

    def step(self, track, fix, kind, at, last, number):
        held = {k: {c: v[0] for c, v in self.entries[k].whole().items()} for k in self.maps}
        before = {k: dict(v) for k, v in held.items()}
        out, last = handed(track, fix, kind, at, last, held["tiles"], held["chunks"], *self.sizes)
        for k, v in held.items():
            for c in before[k].keys() | v.keys():
                if before[k].get(c) != v.get(c):
                    self.entries[k].put(c, None if c not in v else (v[c],))
        return out, last, number

    def ended(self, track):
        out = []
        for k, kind in (("tiles", "tile"), ("chunks", "chunk")):
            for c in sorted(self.entries[k].whole()):
                self.entries[k].put(c, None)
                out.append((track, None, kind, *c, "expire"))
        return out


def handed(track: int, event: int, kind: str, place: Tile, at: Tile | None, tiles: dict[Tile, int], chunks: dict[Tile, int], radius: int, margin: int, far: int, span: int) -> tuple[list[tuple], Tile | None]:
    """One event of a hand-off; changes ``tiles`` and ``chunks``, returns what is loaded and unloaded, and where the track is."""
    if kind == "fix":
        at = place
    elif kind == "tile" and place in tiles:
        tiles[place] = 1
    elif kind == "chunk" and place in chunks:
        chunks[place] = 1
    out: list[tuple] = []
    if at is None:
        return out, at
    e, n = at
    far_away = lambda x, y: max(abs(x - e), abs(y - n))

    def reach(i: int, j: int) -> tuple[int, int]:
        lo, hi = (i * span, j * span), (i * span + span - 1, j * span + span - 1)
        near = max(max(low - p, p - high, 0) for p, low, high in zip(at, lo, hi, strict=True))
        return near, max(max(abs(p - low), abs(p - high)) for p, low, high in zip(at, lo, hi, strict=True))

    for t in entering(at, None, radius):
        if t not in tiles:
            tiles[t] = 0
            out.append((track, event, "tile", *t, "load"))
    for c in ((i, j) for i in range((e - far) // span, (e + far) // span + 1) for j in range((n - far) // span, (n + far) // span + 1)):
        near, most = reach(*c)
        if near <= far and most > radius and c not in chunks:
            chunks[c] = 0
            out.append((track, event, "chunk", *c, "load"))
    for t in sorted(t for t in tiles if far_away(*t) > radius + margin):
        if far_away(*t) > far or chunks.get((t[0] // span, t[1] // span), 1):
            del tiles[t]
            out.append((track, event, "tile", *t, "unload"))
    for c in sorted(chunks):
        near, most = reach(*c)
        inner = [(c[0] * span + i, c[1] * span + j) for i in range(span) for j in range(span)]
        if near > far + margin or most <= radius and all(tiles.get(t) for t in inner):
            del chunks[c]
            out.append((track, event, "chunk", *c, "unload"))
    return out, at


DRAPED = "vertex_id long, ei int, ni int, h double, how string"


class Drape(StatefulProcessor):
    """Vertices on terrain that may come before or after them, by region of tiles.

    A region keeps its terrain. When vertices or terrain come, the tiles concerned
    are draped again: a vertex on terrain gets its height and is done; while some
    vertices of a tile are, the others get the mean of those for now; if none is,
    the tile has failed once more, and from the fourth failure on its vertices get
    the region's last known height, the mean of the tile draped last. A vertex is
    given out whenever its height changes. After ``idle`` the region's state goes.
    """

    def __init__(self, idle_ms: int, failures: int):
        self.idle_ms, self.failures = idle_ms, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.terrain = handle.getMapState("terrain", "ei int, ni int, prow int, pcol int", "h double")
        self.pending = handle.getMapState("pending", "ei int, ni int, vertex_id long", "prow int, pcol int, h double")
        self.tiles = handle.getMapState("tiles", "ei int, ni int", "total double, resolved long, failures int")
        self.region = handle.getValueState("region", "known double, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.forget(timerValues)  # the batch that passes the end may bring rows of a new beginning
        known, due = self.region.get() if self.region.exists() else (None, 0)
        terrain, tiles, pending = Entries(self.terrain), Entries(self.tiles), Entries(self.pending)
        touched, ground = set(), False
        for pdf in rows:
            for kind, ei, ni, prow, pcol, vertex, h, ts in zip(*(pdf[c] for c in ("kind", "ei", "ni", "prow", "pcol", "vertex_id", "h", "ts")), strict=True):
                due = max(due, millis(ts) + self.idle_ms)
                if kind == "terrain":
                    terrain.put((int(ei), int(ni), int(prow), int(pcol)), (float(h),))
                    ground = True
                else:
                    pending.put((int(ei), int(ni), int(vertex)), (int(prow), int(pcol), None))
                    touched.add((int(ei), int(ni)))
        waiting: dict[Tile, list] = {}
        for (ei, ni, vertex), value in sorted(pending.whole().items()):
            waiting.setdefault((ei, ni), []).append((vertex, *value))
        out = []
        for tile in sorted(waiting if ground else touched):
            total, resolved, failed = tiles.get(tile) or (0.0, 0, 0)
            open_ = []
            for vertex, prow, pcol, shown in waiting[tile]:
                if found := terrain.get((*tile, prow, pcol)):
                    total, resolved = total + found[0], resolved + 1
                    pending.put((*tile, vertex), None)
                    out.append((vertex, *tile, found[0], "terrain"))
                else:
                    open_.append((vertex, prow, pcol, shown))
            if resolved:
                known, how = total / resolved, "mean"
            else:
                failed += 1
                how = "last"
            tiles.put(tile, (total, resolved, failed))
            if known is not None and (resolved or failed >= self.failures):
                for vertex, prow, pcol, shown in open_:
                    if shown != known:
                        pending.put((*tile, vertex), (prow, pcol, known))
                        out.append((vertex, *tile, known, how))
        for entries in (terrain, tiles, pending):
            entries.write()
        self.region.update((known, due))
        self.handle.registerTimer(due + 1)
        if out:
            yield pd.DataFrame(out, columns=names(DRAPED))

    def forget(self, timerValues) -> None:
        if self.region.exists() and self.region.get()[1] < timerValues.getCurrentWatermarkInMs():
            for state in (self.terrain, self.pending, self.tiles, self.region):
                state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget(timerValues)
        yield from ()


def drape_stream(vertices: DataFrame, terrain: DataFrame, span: int = 8, late: str = "10 minutes", idle_ms: int = 86_400_000, failures: int = 4) -> DataFrame:
    """(vertex_id, ei, ni, h, how) from streams of vertices (vertex_id, ei, ni, prow, pcol, ts) and of terrain pixels (ei, ni, prow, pcol, h, ts).

    ``how`` is terrain, mean or last; see ``Drape``. A region has ``span`` tiles a side.
    """
    columns = ["ei", "ni", "prow", "pcol", "ts"]
    v = vertices.select(F.lit("vertex").alias("kind"), *columns, "vertex_id", F.lit(None).cast("double").alias("h"))
    t = terrain.select(F.lit("terrain").alias("kind"), *columns, F.lit(None).cast("long").alias("vertex_id"), "h")
    region = {"re": F.floor(F.col("ei") / span).cast("int"), "rn": F.floor(F.col("ni") / span).cast("int")}
    return run(v.unionByName(t).withColumns(region), ["re", "rn"], Drape(idle_ms, failures), DRAPED, late)

