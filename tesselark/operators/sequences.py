"""Plans of reversible steps over the channels of an integer image.

An image is rows (channel, y, x, value); a plan is a list of at most MOST_STEPS
steps.  A plan is checked against the channels' names and sizes before any row
is read; each step is then a transformation of the rows of the channels that it
changes, and undone from what the plan says the channels were before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions.pointwise import forward_rct, inverse_rct
from tesselark.operators import transforms
from tesselark.operators.running import Written

MOST_STEPS, MOST_COLOURS, MOST_CHANNELS = 8, 256, 64


@dataclass(frozen=True)
class Channel:
    name: str
    height: int
    width: int


def _found(channels: list[Channel], first: str, count: int = 1) -> int:
    """Where ``count`` channels in a row begin; they have to exist and be of one size."""
    at = next((i for i, c in enumerate(channels) if c.name == first), None)
    if at is None or at + count > len(channels):
        raise ValueError(f"there are no {count} channels from {first} on")
    if len({(c.height, c.width) for c in channels[at : at + count]}) > 1:
        raise ValueError(f"the {count} channels from {first} on differ in size")
    return at


def _beside(rows: DataFrame, names: list[str]) -> DataFrame:
    """Some channels side by side: y, x and a column v0, v1, ... for each."""
    one = rows.where(F.col("channel").isin(names)).groupBy("y", "x")
    return one.agg(*[F.max(F.when(F.col("channel") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(names)])


def _stacked(wide: DataFrame, columns: dict) -> DataFrame:
    """Columns of ``wide`` as channels again."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), v.cast("long").alias("value")) for n, v in columns.items()]))
    return wide.select("y", "x", each.alias("s")).select("s.channel", "y", "x", "s.value")


@dataclass(frozen=True)
class Rct:
    """A reversible colour transform of three channels from ``first`` on."""

    first: str
    kind: int

    def shape(self, channels: list[Channel]) -> list[Channel]:
        _found(channels, self.first, 3)
        if not 0 <= self.kind < 42:
            raise ValueError(f"there is no colour transform {self.kind}")
        return channels

    def takes(self, channels: list[Channel]) -> list[str]:
        at = _found(channels, self.first, 3)
        return [c.name for c in channels[at : at + 3]]

    gives = takes

    def _mapped(self, rows: DataFrame, channels: list[Channel], transform) -> DataFrame:
        names = self.takes(channels)
        out = transform(*[F.col(f"v{i}") for i in range(3)], self.kind)
        return _stacked(_beside(rows, names), dict(zip(names, out, strict=True)))

    def forward(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        return self._mapped(rows, channels, forward_rct)

    def inverse(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        return self._mapped(rows, channels, inverse_rct)


@dataclass(frozen=True)
class Squeeze:
    """Halves a channel along x (or y): averages keep its name, residuals follow it, named by as many '-' more as no channel has yet."""

    name: str
    along_x: bool = True

    def shape(self, channels: list[Channel]) -> list[Channel]:
        at = _found(channels, self.name)
        c = channels[at]
        size = c.width if self.along_x else c.height
        if size < 2:
            raise ValueError(f"channel {self.name} is too small to be halved")
        halves = [(c.height, n) if self.along_x else (n, c.width) for n in ((size + 1) // 2, size // 2)]
        return [*channels[:at], *[Channel(n, *s) for n, s in zip((c.name, self._rest(channels)), halves, strict=True)], *channels[at + 1 :]]

    def _rest(self, channels: list[Channel]) -> str:
        name = f"{self.name}-"
        while any(c.name == name for c in channels):
            name += "-"
        return name

    @property
    def _place(self) -> tuple[str, str]:
        return ("y", "x") if self.along_x else ("x", "y")

    def takes(self, channels: list[Channel]) -> list[str]:
        return [self.name]

    def gives(self, channels: list[Channel]) -> list[str]:
        return [self.name, self._rest(channels)]

    def forward(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        line, pos = self._place
        pairs = transforms.squeeze(rows.select(F.col(line).alias("line"), F.col(pos).alias("pos"), "value"))
        wide = pairs.select(F.col("line").alias(line), F.col("pos").alias(pos), "average", "residual")
        return _stacked(wide, {self.name: F.col("average"), self._rest(channels): F.col("residual")}).where("value is not null")

    def inverse(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        line, pos = self._place
        pairs = _beside(rows, self.gives(channels)).select(F.col(line).alias("line"), F.col(pos).alias("pos"), F.col("v0").alias("average"), F.col("v1").alias("residual"))
        return transforms.unsqueeze(pairs).select(F.lit(self.name).alias("channel"), F.col("line").alias(line), F.col("pos").alias(pos), "value").select("channel", "y", "x", "value")


@dataclass(frozen=True)
class Palette:
    """Channels from ``first`` on as indices into their distinct colours, which become the channel first + '#', a row a component."""

    first: str
    count: int = 1
    most: int = MOST_COLOURS

    def shape(self, channels: list[Channel]) -> list[Channel]:
        if not 1 <= self.count <= 4 or not 1 <= self.most <= MOST_COLOURS:
            raise ValueError("a palette has one to four channels and at most 256 colours")
        at = _found(channels, self.first, self.count)
        if any(o.name == f"{self.first}#" for o in channels):
            raise ValueError(f"there is a channel {self.first}# already")
        c = channels[at]
        return [*channels[:at], c, *channels[at + self.count :], Channel(f"{self.first}#", self.count, self.most)]

    def takes(self, channels: list[Channel]) -> list[str]:
        at = _found(channels, self.first, self.count)
        return [c.name for c in channels[at : at + self.count]]

    def gives(self, channels: list[Channel]) -> list[str]:
        return [self.first, f"{self.first}#"]

    def forward(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        names = self.takes(channels)
        wide, columns = _beside(rows, names), [f"v{i}" for i in range(self.count)]
        colours = transforms.palette(wide, columns, self.most)
        if colours.isEmpty() and not wide.isEmpty():
            raise ValueError(f"channel {self.first} has more than {self.most} colours")
        index = wide.join(F.broadcast(colours), columns)  # at most ``most`` rows
        table = colours.select(F.posexplode(F.array(*columns)).alias("y", "value"), F.col("index").alias("x"))
        table = table.select(F.lit(f"{self.first}#").alias("channel"), F.col("y").cast("long").alias("y"), "x", "value")
        return _stacked(index, {self.first: F.col("index")}).unionByName(table)

    def inverse(self, rows: DataFrame, channels: list[Channel]) -> DataFrame:
        names = self.takes(channels)
        table = F.broadcast(rows.where(F.col("channel") == f"{self.first}#").select(F.col("y").alias("component"), F.col("x").alias("index"), F.col("value").alias("colour")))
        index = rows.where(F.col("channel") == self.first).select("y", "x", F.col("value").alias("index"))
        name = F.get(F.array(*map(F.lit, names)), F.col("component").cast("int"))
        return index.join(table, "index").select(name.alias("channel"), "y", "x", F.col("colour").alias("value"))


def planned(channels: list[Channel], steps: list) -> list[list[Channel]]:
    """The channels before each step and at the end; a plan that can't be followed is refused."""
    if len(steps) > MOST_STEPS:
        raise ValueError(f"{len(steps)} steps; at most {MOST_STEPS} are allowed")
    if len({c.name for c in channels}) < len(channels) or any(c.height < 1 or c.width < 1 for c in channels):
        raise ValueError("channels need different names and some samples")
    out = [list(channels)]
    for s in steps:
        out.append(s.shape(out[-1]))
        if len(out[-1]) > MOST_CHANNELS:
            raise ValueError(f"more than {MOST_CHANNELS} channels")
    return out


class _Image:
    """The tables that hold an image's channels.

    A step reads those that it changes and writes what comes of them, so the
    plan of a channel never grows and the others are not touched.
    """

    def __init__(self, rows: DataFrame, channels: list[Channel]):
        self.store = Written(rows.sparkSession)
        self.of = {c.name: rows.select("channel", "y", "x", "value") for c in channels}

    def rows(self, names: list[str]) -> DataFrame:
        by_table: dict[int, tuple[DataFrame, list[str]]] = {}
        for n in names:
            by_table.setdefault(id(self.of[n]), (self.of[n], []))[1].append(n)
        parts = [t.where(F.col("channel").isin(own)) for t, own in by_table.values()]
        return reduce(DataFrame.unionByName, parts)

    def change(self, step, taken: list[str], given: list[str]) -> None:
        found, _ = self.store.write(step(self.rows(taken)))
        for n in taken:
            del self.of[n]
        self.of |= dict.fromkeys(given, found)


def forward(rows: DataFrame, channels: list[Channel], steps: list) -> DataFrame:
    """The image after all steps, in order."""
    shapes = planned(channels, steps)
    image = _Image(rows, channels)
    for s, before in zip(steps, shapes, strict=False):
        image.change(lambda r, s=s, b=before: s.forward(r, b), s.takes(before), s.gives(before))
    return image.rows(list(image.of))


def inverse(rows: DataFrame, channels: list[Channel], steps: list) -> DataFrame:
    """The image that ``steps`` took to ``rows``; ``channels`` are those it had at first."""
    shapes = planned(channels, steps)
    image = _Image(rows, shapes[-1])
    for s, before in reversed(list(zip(steps, shapes, strict=False))):
        image.change(lambda r, s=s, b=before: s.inverse(r, b), s.gives(before), s.takes(before))
    return image.rows(list(image.of))
