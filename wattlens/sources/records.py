"""Records of delimited text whose quoted values may hold line breaks, found without reading a file in one task.

A line does one of few things to the two states of a reader: outside quotes it may leave a value open; inside them it may
go on, close the value, or prove by a quote that closes nothing that the opening quote was a stray one. That is one code
per line. A record begins where the one before it has ended, so the first record of a split depends on the split
before it. Every task of the first pass walks its split from each place where the first record may begin, and sends one
short row: the codes at both ends and where each walk arrives. A scan over these rows, file by file, settles the first
record of every split and the records that cross a border. The second pass then forms the records of all splits.

A quote that isn't closed within `MOST_LINES` lines, by the file's end, or before a quote that can't close it, is a stray one:
its line is a record of its own without quotes, and the next line begins a new record.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_LINES = 100
RECORD = "struct<text: string, fields: int, repaired: boolean>"
SPLIT = ("file bigint, block bigint, lines bigint, reach array<int>, head binary, tail binary, head_lines array<string>, "
         "tail_lines array<string>")


def automaton(delimiter: str, most: int):
    """(code, after, record, records, by_split): what workers need; nested functions travel to them with their code.

    code(line): 1 if the line leaves a quoted value open; plus 0, 2 or 4 if, begun inside a value, it ends outside, ends
    inside, or is no part of one. after(codes, i, ended): the line where the next record begins and whether the one at i
    is whole; the line is 0 if that takes more lines to tell. records(lines): all records of lines that are complete.
    """
    import re
    blank = " *" if delimiter == "\t" else "[ \t]*"
    follows = re.compile(rf"{blank}(?:{re.escape(delimiter)}|\Z)")
    opens = re.compile(rf'{blank}"')

    def close(line: str, at: int, strict: bool) -> int:
        """The place behind the quote that closes a value and its delimiter; -1: none; -2: a quote that can't be there."""
        while True:
            at = line.find('"', at)
            if at < 0:
                return -1
            if line.startswith('""', at):
                at += 2
                continue
            found = follows.match(line, at + 1)
            if found:
                return found.end() if found.end() > at + 1 and line[found.end() - 1] == delimiter else len(line) + 1
            if strict:
                return -2
            at += 1

    def fields(line: str, at: int = 0) -> tuple[int, bool]:
        """Fields that begin from `at` on, and whether the last one is left open."""
        count = 0
        while at <= len(line):
            count += 1
            quoted = opens.match(line, at)
            if quoted:
                at = close(line, quoted.end(), False)
                if at < 0:
                    return count, True
            else:
                at = line.find(delimiter, at) + 1 or len(line) + 1
        return count, False

    def code(line: str) -> int:
        if '"' not in line:
            return 2
        at = close(line, 0, True)
        inside = 1 if at == -1 else 2 if at == -2 else int(at <= len(line) and fields(line, at)[1])
        return int(fields(line)[1]) + 2 * inside

    def after(codes, i: int, ended: bool = False) -> tuple[int, bool]:
        if not codes[i] & 1:
            return i + 1, True
        for j in range(i + 1, min(i + most, len(codes))):
            if codes[j] >> 1 != 1:
                return (j + 1, True) if codes[j] >> 1 == 0 else (i + 1, False)
        return (i + 1, False) if ended or i + most <= len(codes) else (0, False)

    def record(lines: list[str], whole: bool) -> tuple[str, int, bool]:
        if not whole:
            text = lines[0].replace('"', "")
            return text, text.count(delimiter) + 1, True
        if len(lines) == 1 and '"' not in lines[0]:
            return lines[0], lines[0].count(delimiter) + 1, False
        count, _ = fields(lines[0])
        for line in lines[1:]:
            at = close(line, 0, True)
            count += fields(line, at)[0] if 0 <= at <= len(line) else 0
        return "\n".join(lines), count, False

    def records(lines: list[str]) -> list[tuple[str, int, bool]]:
        codes, out, i = [code(line) for line in lines], [], 0
        while i < len(lines):
            end, whole = after(codes, i, True)
            out.append(record(lines[i:end], whole))
            i = end
        return out

    def by_split(batch) -> list[tuple[tuple[int, int], list[str]]]:
        """The lines of a batch by split, in order."""
        file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(file)]
        return [((int(file[a]), int(block[a])), batch.column(2).slice(a, b - a).to_pylist())
                for a, b in zip(bounds, bounds[1:]) if a < b]

    return code, after, record, records, by_split


def numbered_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines in file order with their split: digest of the file's path, and where the split begins."""
    return spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"))


def split_rows(lines: DataFrame, delimiter: str, most: int = MOST_LINES) -> DataFrame:
    """One row per split: its lines, the codes and lines that borders need, and where walks from its first lines arrive."""
    code, after, _, _, by_split = automaton(delimiter, most)

    def summary(key: tuple, codes: bytearray, head: list[str], tail: list[str]) -> dict:
        count = len(codes)
        zone = max(0, count - most + 1)  # walks end at their first record that begins here
        opening = np.flatnonzero(np.frombuffer(codes, np.uint8)[:zone] & 1)
        arrival: dict[int, int] = {}  # of the walks through an opening line
        reach = []
        for at in range(min(most, count + 1)):
            passed = []
            while at < zone:
                k = int(np.searchsorted(opening, at))
                line = int(opening[k]) if k < len(opening) else zone
                if line == zone or line in arrival:
                    at = arrival.get(line, zone)
                    break
                passed.append(line)
                at = after(codes, line)[0]
            arrival.update(dict.fromkeys(passed, at))
            reach.append(at)
        first = next((i for i, c in enumerate(codes[:most]) if c >> 1 != 1), min(most, count))
        inside = head[:first + 1] if first < min(most, count) else head  # a value left open before ends there, or goes on
        open_from = count
        for i in range(count - 1, zone - 1, -1):
            open_from = i if codes[i] & 1 else open_from
            if codes[i] >> 1 != 1:
                break
        return {"file": key[0], "block": key[1], "lines": count, "reach": reach, "head": bytes(codes[:most]),
                "tail": bytes(codes[zone:]), "head_lines": inside if first < most else [],
                "tail_lines": tail[len(tail) - (count - open_from):] if open_from < count else []}

    def run(batches):
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("lines", pa.int64()), ("reach", pa.list_(pa.int32())),
                            ("head", pa.binary()), ("tail", pa.binary()), ("head_lines", pa.list_(pa.string())),
                            ("tail_lines", pa.list_(pa.string()))])
        key, codes, head, tail = None, bytearray(), [], []
        for batch in batches:
            for own, lines_of_split in by_split(batch):
                if own != key:
                    if key:
                        yield pa.RecordBatch.from_pylist([summary(key, codes, head, tail)], schema)
                    key, codes, head, tail = own, bytearray(), [], []
                head += lines_of_split[:max(0, most - len(codes))]
                tail = (tail + lines_of_split)[-most:]
                codes += bytes(map(code, lines_of_split))
        if key:
            yield pa.RecordBatch.from_pylist([summary(key, codes, head, tail)], schema)

    return lines.mapInArrow(run, SPLIT)


def settled(splits: DataFrame, delimiter: str, most: int = MOST_LINES) -> DataFrame:
    """(file, block, lines, entry, stop, border): the line where a split's first record begins, the line from which on
    records may cross its end, and those records. The first line of a file is its header."""
    _, after, _, records, _ = automaton(delimiter, most)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block").to_dict("records")
        out, entry, owner = [], 1, None  # owner: the row whose last record reaches into this split
        for at, row in enumerate(rows):
            count = int(row["lines"])
            own = {"file": row["file"], "block": row["block"], "lines": count, "entry": min(entry, count), "stop": count,
                   "border": []}
            out.append(own)
            if owner is not None and entry:
                owner["_lines"] += list(row["head_lines"])[:min(entry, count)]
            if entry >= count:  # the header alone, or lines of a record from before
                entry -= count
                owner = owner if entry else None
                continue
            zone = count - len(row["tail"])
            start = int(row["reach"][entry]) if entry < zone else entry
            codes, more = bytearray(row["tail"]), at + 1
            while more < len(rows) and len(codes) < len(row["tail"]) + most:
                codes += rows[more]["head"]
                more += 1
            own["stop"], owner = count, None
            while start < count:
                if own["stop"] == count and after(row["tail"], start - zone)[0] == 0:
                    own["stop"], owner = start, own
                    own["_lines"] = list(row["tail_lines"])[len(row["tail_lines"]) - (count - start):]
                start = after(codes, start - zone, more >= len(rows))[0] + zone
            entry = start - count
        for own in out:
            own["border"] = [dict(zip(("text", "fields", "repaired"), r)) for r in records(own.pop("_lines", []))]
        return pd.DataFrame(out)

    return splits.groupBy("file").applyInPandas(
        scan, f"file bigint, block bigint, lines bigint, entry bigint, stop bigint, border array<{RECORD}>")


def formed(lines: DataFrame, borders: DataFrame, delimiter: str, most: int = MOST_LINES) -> DataFrame:
    """(text, fields, repaired): all records in file order.

    `borders` has one short row per split, as many as the driver lists when it plans the scan; workers get it whole.
    """
    code, after, record, _, by_split = automaton(delimiter, most)
    known = {(r["file"], r["block"]): (r["entry"], r["stop"], [tuple(b) for b in r["border"]]) for r in borders.collect()}
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        key, at, stop, border, pending, codes, out = None, 0, 0, [], [], bytearray(), []

        def walk(ended: bool) -> None:
            while pending:
                end, whole = after(codes, 0, ended)
                if not end:
                    return
                out.append(record(pending[:end], whole))
                del pending[:end], codes[:end]

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                                               pa.array(columns[2], pa.bool_())], names=["text", "fields", "repaired"])

        for batch in batches:
            for own, lines_of_split in by_split(batch):
                if own != key:
                    walk(True)
                    out.extend(border)
                    if own not in shared.value:
                        raise ValueError("the scan is split in another way than when its splits were settled")
                    key, at, (entry, stop, border) = own, 0, shared.value[own]
                for line in lines_of_split[max(0, entry - at):max(0, stop - at)]:
                    if not pending and '"' not in line:
                        out.append((line, line.count(delimiter) + 1, False))
                    else:
                        pending.append(line)
                        codes.append(code(line))
                        walk(False)
                at += len(lines_of_split)
            yield taken()
        walk(True)
        out.extend(border)
        yield taken()

    return lines.mapInArrow(run, "text string, fields int, repaired boolean")
