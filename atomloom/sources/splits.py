"""Structure files read in splits: one large file goes through many tasks.

Spark cuts text files by byte ranges and hands out whole lines. Tasks gather the lines of a range in chunks of some megabytes
and note, for every state in which a chunk may begin (before the atom loop, in its header, in its rows, in a text field), the
state in which it ends. These notes, a row a chunk, are put together file by file, which tells each chunk where it begins: the
names of the loop and how many values came before. Then chunks are parsed on their own; rows that a boundary cuts are put
together from their parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.sources.structures import _CIF_WORD, RAW_SCHEMA, cif_record, is_structure_file, pdb_line_atoms, residues_of

#: Bytes of lines after which a chunk ends; a longer line makes a longer chunk.
CHUNK_BYTES = 8 << 20
CHUNK_SCHEMA = "path string, block long, seq int, format string, text string, notes string"
STATE_SCHEMA = "path string, block long, seq int, state string, leads boolean"
#: A row of the loop, or a part of one (record, at, cells): ``at`` counts the values of the file before the part.
PART_SCHEMA = RAW_SCHEMA.replace("atom_ord int", "record long") + ", model string, alternative string, block long, seq int, names array<string>, at long, cells array<string>, is_text boolean"


@dataclass(frozen=True)
class LoopState:
    """Where in the atom_site loop a text is: ``seek``, ``header``, ``rows`` or ``done``; the loop's names, the values so far,
    and whether a text field is open, which is counted already."""

    mode: str = "seek"
    names: list[str] = field(default_factory=list)
    count: int = 0
    in_text: bool = False


@dataclass
class LoopPart:
    """What one chunk has of the loop: values from ``first`` on, the rest of a text field that began before, and the beginning of
    one that goes on."""

    first: int
    values: list[str | None] = field(default_factory=list)
    head_text: list[str] | None = None
    tail_text: list[str] | None = None


def read_loop(lines: list[str], state: LoopState, keep: bool = True) -> tuple[LoopState, LoopPart]:
    """The state after ``lines`` and, if ``keep``, what they hold of the loop. Without, values are only counted."""
    mode, names, count, text = state.mode, list(state.names), state.count, [] if state.in_text else None
    part = LoopPart(count)
    began_before = state.in_text
    for line in lines:
        if mode in ("seek", "header"):
            if line.strip().startswith("_atom_site."):
                names.append(line.split()[0].removeprefix("_atom_site."))
                mode = "header"
                continue
            if mode == "seek":
                continue
            mode = "rows"
        if mode == "done":
            break
        if text is not None:
            if not line.startswith(";"):
                text.append(line)
                continue
            if began_before:
                part.head_text = text
            elif keep:
                part.values.append("\n".join(text).strip())
            text, began_before, line = None, False, line[1:]
        elif line.startswith(";"):
            text, count = [line[1:]], count + 1
            continue
        line = line.strip()
        if line.startswith(("#", "_", "loop_", "data_")):
            mode = "done"
            break
        if not keep and "'" not in line and '"' not in line:
            count += len(line.split())
            continue
        found = [None if plain in (".", "?") else single or double or plain for single, double, plain in _CIF_WORD.findall(line)]
        count += len(found)
        if keep:
            part.values += found
    if text is not None:
        if began_before:
            part.head_text = text
        else:
            part.tail_text = text
    return LoopState(mode, names, count, text is not None), part


def notes_of(lines: list[str], is_cif: bool) -> dict:
    """What a chunk does to each state it may begin in (mmCIF), or its lines and the first that ends a model (PDB)."""
    if not is_cif:
        return {"lines": len(lines), "ends": next((k for k, line in enumerate(lines) if line.startswith("ENDMDL")), None)}
    starts = {"seek": LoopState(), "header": LoopState("header"), "rows": LoopState("rows"), "text": LoopState("rows", in_text=True)}
    return {name: asdict(read_loop(lines, s, keep=False)[0]) for name, s in starts.items()}


def after(state: LoopState, notes: dict) -> LoopState:
    """The state after a chunk that began in ``state``."""
    if state.mode == "done":
        return state
    end = LoopState(**notes["text" if state.in_text else state.mode])
    return replace(end, names=state.names + end.names, count=state.count + end.count)


def structure_chunks(spark: SparkSession, directory: str, recursive: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, block, seq, format, text, notes): the lines of the structure files of a directory in chunks, in the file's order by
    (block, seq)."""
    rows = spark.read.option("recursiveFileLookup", recursive).text(directory).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, size, seq = None, [], 0, 0

        def flush() -> pa.RecordBatch:
            is_cif = now[0].lower().endswith((".cif", ".mmcif"))
            columns = [[now[0]], [now[1]], [seq], ["cif" if is_cif else "pdb"], ["\n".join(lines)], [json.dumps(notes_of(lines, is_cif))]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["path", "block", "seq", "format", "text", "notes"])

        for batch in batches:
            for line, path, block in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "block")), strict=True):
                if (path, block) != now or size >= chunk_bytes:
                    if lines:
                        yield flush()
                    seq = seq + 1 if (path, block) == now else 0
                    now, lines, size = (path, block), [], 0
                lines.append(line)
                size += len(line) + 1
        if lines:
            yield flush()

    return rows.filter(is_structure_file(F.col("path"))).mapInArrow(gathered, CHUNK_SCHEMA)


def chunk_states(chunks: DataFrame) -> DataFrame:
    """(path, block, seq, state, leads): the state in which each chunk begins; ``leads`` if the loop's first row may be in it. A
    file's chunks meet here without their lines."""

    def folded(notes: pd.DataFrame) -> pd.DataFrame:
        notes = notes.sort_values(["block", "seq"])
        states, leads = [], []
        cif, line, ended = LoopState(), 0, False
        for text, kind in zip(notes["notes"], notes["format"], strict=True):
            found = json.loads(text)
            if kind == "cif":
                states.append(json.dumps(asdict(cif)))
                begins, cif = cif, after(cif, found)
                leads.append(begins.mode != "done" and (not begins.names or begins.count <= len(begins.names)))
                continue
            # the very first line of a file ends no model
            ends = found["ends"] if found["ends"] or line else None
            states.append(json.dumps({"line": line, "stop": 0 if ended else ends}))
            leads.append(False)
            line, ended = line + found["lines"], ended or ends is not None
        return pd.DataFrame({"path": notes["path"], "block": notes["block"], "seq": notes["seq"], "state": states, "leads": leads})

    return chunks.select("path", "block", "seq", "format", "notes").groupBy("path").applyInPandas(folded, STATE_SCHEMA)


def cif_parts(placed: DataFrame) -> DataFrame:
    """Rows of the loops of placed chunks, and parts of the rows that cross their ends."""
    names_of = [c.split()[0] for c in PART_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 3, pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.bool_()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, seq, text, state in zip(*(batch.column(c) for c in ("path", "block", "seq", "text", "state")), strict=True):
                begin = LoopState(**json.loads(state.as_py()))
                end, part = read_loop(text.as_py().split("\n"), begin)
                names, values, width = end.names, part.values, max(1, len(end.names))
                rows, place = [], (block.as_py(), seq.as_py())

                def add_part(at: int, cells: list, is_text: bool) -> None:
                    rows.append((path.as_py(), at // width, *[None] * 12, *place, names, at, cells, is_text))  # noqa: B023

                first = -(-part.first // width) * width
                last = (part.first + len(values)) // width * width
                if part.head_text is not None:
                    add_part(part.first - 1, ["\n".join(part.head_text)], True)
                if values[: first - part.first]:
                    add_part(part.first, values[: first - part.first], False)
                for at in range(first, last, width):
                    model, alternative, fields = cif_record(names, values[at - part.first : at - part.first + width])
                    rows.append((path.as_py(), at // width, *fields, model, alternative, *place, None, None, None, None))
                rest = values[max(last, first) - part.first :]
                if rest:
                    add_part(max(last, first), rest, False)
                if part.tail_text is not None:
                    add_part(part.first + len(values), ["\n".join(part.tail_text)], True)
                for at in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names=names_of)

    return placed.select("path", "block", "seq", "text", "state").mapInArrow(parsed, PART_SCHEMA)


def whole_rows(parts: DataFrame) -> DataFrame:
    """The rows that ``cif_parts`` found in parts, put together; there are at most two parts a chunk beside text fields."""
    cut = parts.filter(F.col("names").isNotNull()).groupBy("structure_id", "record").agg(F.max("names").alias("names"), F.array_sort(F.collect_list(F.struct("at", "block", "seq", "is_text", "cells"))).alias("parts"))
    rows = parts.filter(F.col("names").isNull()).drop("block", "seq", "names", "at", "cells", "is_text")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                width = len(row["names"])
                cells, texts = [None] * width, {}
                for p in row["parts"]:
                    if p["is_text"]:
                        texts.setdefault(p["at"] % width, []).extend(p["cells"])
                    else:
                        cells[p["at"] % width : p["at"] % width + len(p["cells"])] = p["cells"]
                for k, found in texts.items():
                    cells[k] = "\n".join(found).strip()
                model, alternative, fields = cif_record(row["names"], cells)
                out.append(dict(zip(arrow.names, (row["structure_id"], row["record"], *fields, model, alternative), strict=True)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in rows.dtypes])
    return rows.unionByName(cut.mapInArrow(joined, rows.schema))


def split_atoms(spark: SparkSession, directory: str, recursive: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Raw atom rows of the structure files of a directory, each file by as many tasks as it has splits.

    The rows of ``raw_atoms`` of the same files. A file's first model is told by its first row, which a second, small pass over
    the chunks around it finds.
    """
    chunks = structure_chunks(spark, directory, recursive, chunk_bytes)
    states = chunk_states(chunks)
    placed = chunks.join(states, ["path", "block", "seq"])
    loops = placed.filter((F.col("format") == "cif") & (F.get_json_object("state", "$.mode") != "done"))
    rows = whole_rows(cif_parts(loops))
    first = whole_rows(cif_parts(loops.filter("leads"))).filter(F.col("record") == 0).select("structure_id", F.col("model").alias("first_model"))
    kept = rows.join(first, "structure_id").filter((F.col("model") == F.col("first_model")) & (F.col("alternative").isNull() | (F.col("alternative") == "A")))
    cif = kept.withColumn("atom_ord", (F.col("record") + 1).cast("int")).drop("record", "model", "alternative", "first_model")

    stop = F.get_json_object("state", "$.stop").cast("int")
    lines = F.split("text", "\n")
    models = placed.filter(F.col("format") == "pdb").select("path", F.get_json_object("state", "$.line").cast("long").alias("before"), F.when(stop.isNull(), lines).otherwise(F.slice(lines, 1, F.greatest(stop, F.lit(0)))).alias("lines"))
    numbered = models.select(F.col("path").alias("structure_id"), "before", F.posexplode("lines").alias("k", "line"))
    pdb = pdb_line_atoms(numbered.select("structure_id", (F.col("before") + F.col("k")).cast("int").alias("atom_ord"), "line"))
    found = pdb.unionByName(cif)
    return found.withColumn("structure_id", F.regexp_replace("structure_id", "^file:///", "file:/"))


def read_structures_in_splits(spark: SparkSession, directory: str, recursive: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The atom relation of the structure files of a directory, as of ``parse_structures(read_structures(...))``."""
    return residues_of(split_atoms(spark, directory, recursive, chunk_bytes))
