"""Elements of XML files, each file read by many tasks.

A file is cut into byte ranges, and a range owns the elements that begin in it; its task reads on to the end of the last one. Whether a
border lies in a comment, a CDATA section or a processing instruction is found first: each range tells, for each state that it can
begin in, the state that it ends in, and these steps are composed along the file. Ranges are rows, so a job over
any number of files has no list of them on the driver. Files compressed in blocks (see `blocks`) are cut at blocks, and places are counted
in their content.
"""

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.sources import blocks
from ionframe.sources.heads import encoding_of, locate

#: Bytes that a task asks the file system for at a time, and of elements in a batch of rows.
BLOCK, BATCH = 1 << 20, 4 << 20
#: Bytes that a search goes back behind what it has read, more than any opening or closing token has.
TOKEN = 512
#: A task reads one range while there are this many tasks at most, then several ranges of about so many bytes; and tasks of a job at most.
FEW_TASKS, TASK_BYTES, MOST_TASKS = 200, 32 << 20, 50_000

# What markup is ignored in, by state; state 0 is none of these. Fixed by the XML grammar.
_CLOSERS = (b"", b"-->", b"]]>", b"?>")
_OPENERS = {b"<!--": 1, b"<![CDATA[": 2, b"<?": 3}
_ANY_OPENER = rb"<!--|<!\[CDATA\[|<\?"
_START_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")


class Bytes:
    """The bytes of an open file from some place on, read as far as searches need them. Places are counted from the file's start."""

    def __init__(self, file, start: int):
        self.file, self.base, self.held, self.ended = file, start, b"", False
        file.seek(start)

    def _more(self) -> None:
        block = self.file.read(BLOCK)
        self.held, self.ended = self.held + block, not block

    def search(self, pattern: re.Pattern, at: int, limit: int | None = None, there: bool = False) -> tuple[int, int, bytes] | None:
        """(start, end, text) of the first match that begins at `at` or later (`there`: at `at`) and, if there is a limit, ends there or
        before."""
        place, find = at - self.base, pattern.match if there else pattern.search
        while True:
            found = find(self.held, place)
            if found and (found.end() < len(self.held) or self.ended):
                if limit is not None and self.base + found.end() > limit:
                    return None
                return self.base + found.start(), self.base + found.end(), found.group()
            if self.ended or limit is not None and self.base + len(self.held) >= limit + TOKEN:
                return None
            if not there:
                place = max(place, len(self.held) - TOKEN)
            self._more()

    def finish(self) -> None:
        while not self.ended:
            self._more()

    def between(self, start: int, end: int | None = None) -> bytes:
        return self.held[start - self.base : None if end is None else end - self.base]

    def forget(self, before: int) -> None:
        """Drops what lies before a place, once that is worth a copy."""
        if before - self.base > BLOCK:
            self.held, self.base = self.held[before - self.base :], before


_CLOSER_PATTERNS = tuple(re.compile(re.escape(c)) for c in _CLOSERS)
_OPENER_PATTERN = re.compile(_ANY_OPENER)


def _left(data: Bytes, start: int, end: int, state: int) -> int | None:
    """Where a range that begins in `state` gets out of it; null if not before its end. A closer may begin before the border."""
    if not state:
        return start
    found = data.search(_CLOSER_PATTERNS[state], max(start - len(_CLOSERS[state]) + 1, 0), end)
    return found[1] if found else None


def end_state(data: Bytes, start: int, end: int, state: int) -> int:
    """The state at a range's end, if it begins in `state`. An opener that crosses the end counts as open there."""
    at = _left(data, start, end, state)
    return state if at is None else _sections(data, at, end)[1]


def _sections(data: Bytes, at: int, end: int) -> tuple[list[tuple[int, int]], int]:
    """The (start, end) of comments and their like between two places, the first of which is in none, and the state at the second."""
    found_here = []
    while (found := data.search(_OPENER_PATTERN, at)) and found[0] < end:
        state = _OPENERS[found[2]]
        closer = data.search(_CLOSER_PATTERNS[state], found[1], end)
        if closer is None:
            return [*found_here, (found[0], end + 1)], state
        at = closer[1]
        found_here.append((found[0], at))
        data.forget(at - TOKEN)
    return found_here, 0


def end_states(file, start: int, end: int) -> list[int]:
    """`end_state` for each state that a range can begin in. Out of its first state, a range goes on as one that begins in none, unless it gets
    out within what is a comment or its like there."""
    sections, free = _sections(Bytes(file, _before(start)), start, end)
    states = [free]
    for state in range(1, len(_CLOSERS)):
        at = _left(Bytes(file, _before(start)), start, end, state)
        if at is not None and any(a < at < b for a, b in sections):
            states.append(end_state(Bytes(file, _before(start)), start, end, state))
        else:
            states.append(state if at is None else free)
    return states


def elements(data: Bytes, start: int, end: int, state: int, tag: str) -> Iterator[bytes]:
    """The elements named `tag` that begin in a range. They must not lie in each other. One that the file ends in is given as far as it
    goes."""
    name = re.escape(tag.encode())
    token = re.compile(_ANY_OPENER + rb"|<" + name + rb"(?=[\s/>])|</" + name + rb"\s*>")

    def following(at: int) -> tuple[int, int, bytes] | None:
        """The next tag with that name, outside of comments and their like."""
        while (found := data.search(token, at)) and found[2] in _OPENERS:
            closer = data.search(_CLOSER_PATTERNS[_OPENERS[found[2]]], found[1])
            if closer is None:
                return None
            at = closer[1]
        return found

    at = _left(data, start, end, state)
    while at is not None and (found := following(at)) and found[0] < end:
        begin, at = found[:2]
        if found[2].startswith(b"</"):  # of an element that an earlier range owns
            data.forget(begin)
            continue
        opened = data.search(_START_TAG, begin, there=True)
        if opened and opened[2].endswith(b"/>"):
            at = opened[1]
        else:
            last = opened and following(opened[1])
            at = last[1] if last else None
        if at is None:
            data.finish()
        yield data.between(begin, at)
        if at is not None:
            data.forget(at)


RANGES = "run_id string, path string, start long, end long, at long, base long"


def file_ranges(spark: SparkSession, paths, range_bytes: int) -> DataFrame:
    """(run_id, path, start, end, at, base): the byte ranges of files. Contents are not read. `at` is the place in a compressed file from
    which a range can be read, and `base` that place in its content; both are 0 for other files."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("run_id"), "path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    blocked = F.col("path").endswith(blocks.SUFFIX)
    plain = files.where(~blocked).select("run_id", "path", starts.alias("start"), "length").select(
        "run_id", "path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("base")
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, file in _opened(batch):
                found = [{"run_id": row["run_id"], "path": row["path"], **r} for r in block_ranges(file, range_bytes)]
                yield pa.RecordBatch.from_pylist(found, _RANGES_ARROW)

    return plain.unionByName(files.where(blocked).select("run_id", "path").mapInArrow(cut, RANGES))


_RANGES_ARROW = pa.schema([(n, pa.string()) for n in ("run_id", "path")] + [(n, pa.int64()) for n in ("start", "end", "at", "base")])


def block_ranges(file, range_bytes: int) -> Iterator[dict]:
    """The ranges of a file compressed in blocks: runs of blocks with at least so many bytes of content, but for the last."""
    start, at, base, known = 0, 0, 0, [(0, 0)]
    for place in blocks.places(file):
        known.append(place)
        if place[0] - start >= range_bytes:
            yield {"start": start, "end": place[0], "at": at, "base": base}
            start = place[0]
            # What is before the border is looked at too, so the next range begins to read at an earlier block.
            base, at = next(k for k in reversed(known) if k[0] <= _before(start))
            known = [k for k in known if k[0] >= base]
    if known[-1][0] > start:
        yield {"start": start, "end": known[-1][0], "at": at, "base": base}


def _before(start: int) -> int:
    """From where a range is read: a closer may begin before the border."""
    return max(start - len(max(_CLOSERS, key=len)), 0)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, object]]:
    for row in batch.to_pylist():
        filesystem, inner = locate(row["path"])
        with filesystem.open_input_file(inner) as file:
            yield row, file


def _content(row: dict, file, start: bool = False):
    """The content of a range's file as a file, from its own first block on or from the `start` of the file."""
    if not blocks.is_blocked(row["path"]):
        return file
    return blocks.Blocks(file) if start else blocks.Blocks(file, row["at"], row["base"])


def _with_states(ranges: DataFrame) -> DataFrame:
    """The ranges with the state that each begins in."""

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for row, file in _opened(batch):
                to.append(end_states(_content(row, file), row["start"], row["end"]))
            yield pa.record_batch([*batch.columns, pa.array(to, pa.list_(pa.int32()))], names=[*batch.schema.names, "to"])

    stepped = ranges.mapInArrow(steps, f"{RANGES}, to array<int>")
    ordered = stepped.groupBy("run_id", "path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "at", "base", "to"))).alias("ranges"))
    states = F.aggregate(
        "ranges", F.array(F.lit(0)), lambda known, r: F.concat(known, F.array(F.get(r["to"], F.element_at(known, -1))))
    )
    each = ordered.withColumn("states", states).select("run_id", "path", "states", F.posexplode("ranges").alias("i", "r"))
    return each.select("run_id", "path", "r.start", "r.end", "r.at", "r.base", F.get("states", F.col("i")).alias("state"))


def read_element_texts(spark: SparkSession, paths, tag: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(run_id, xml): the elements named `tag` of the files, each as its text; run_id is the file. Files are read twice, in ranges of
    `range_bytes`: once for what the borders lie in, once for the elements. Their bytes have to be those of an encoding that keeps ASCII
    (all but UTF-16 and UTF-32), as declared in the file's first bytes."""
    ranges = file_ranges(spark, paths, range_bytes)
    n = ranges.count()
    tasks = max(1, min(n, max(FEW_TASKS, n * range_bytes // TASK_BYTES), MOST_TASKS))

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(run_id: str, found: list[str]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([run_id] * len(found), pa.string()), pa.array(found, pa.string())], names=["run_id", "xml"])

        for batch in batches:
            for row, file in _opened(batch):
                encoding, held, size = encoding_of(_content(row, file, start=True).read(TOKEN)), [], 0
                for element in elements(Bytes(_content(row, file), _before(row["start"])), row["start"], row["end"], row["state"], tag):
                    held.append(element.decode(encoding, "replace"))
                    size += len(element)
                    if size > BATCH:
                        yield given(row["run_id"], held)
                        held, size = [], 0
                yield given(row["run_id"], held)

    return _with_states(ranges.repartition(tasks)).repartition(tasks).mapInArrow(texts, "run_id string, xml string")
