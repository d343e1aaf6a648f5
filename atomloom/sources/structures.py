"""Structure files and atom rows as one atom relation.

Atom relation: structure_id, residue_ord, chain_id, res_index, res_name, modality, hetero, atom_ord, atom_name, element,
x, y, z. Rows are unordered in Spark, so the two ordinals carry the file's order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress, islice, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.functions.vocab import MODALITIES, STRUCTURE_SUFFIXES, WATERS, atom_slots, classify_residue, infer_element, normalize_element

RAW_SCHEMA = "structure_id string, atom_ord int, chain_id string, res_id int, insertion string, res_name string, atom_name string, element string, x double, y double, z double, hetero boolean"


def is_structure_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(STRUCTURE_SUFFIXES) + ")$")


def list_structure_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Paths of the structure files of a directory in order; contents are not read. A missing directory is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
    return files.select("path").filter(is_structure_file(F.col("path"))).orderBy("path")


def read_structures(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """(structure_id, format, content) of the structure files of a directory; the id is the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
    cif = F.lower("path").rlike(r"\.(cif|mmcif)$")
    return files.filter(is_structure_file(F.col("path"))).select(F.col("path").alias("structure_id"), F.when(cif, "cif").otherwise("pdb").alias("format"), F.decode("content", "UTF-8").alias("content"))


def pdb_atoms(texts: DataFrame) -> DataFrame:
    """Raw atom rows of fixed-width PDB text: first model, alternative location blank or A."""
    first_model = F.substring_index(F.col("content"), "\nENDMDL", 1)
    return pdb_line_atoms(texts.select("structure_id", F.posexplode(F.split(first_model, "\r?\n")).alias("atom_ord", "line")))


def pdb_line_atoms(lines: DataFrame) -> DataFrame:
    """Raw atom rows of (structure_id, atom_ord, line) rows of first models."""
    part = lambda start, length: F.trim(F.substring("line", start, length))
    record = F.substring("line", 1, 6)
    kept = lines.filter(record.isin("ATOM  ", "HETATM") & F.substring("line", 17, 1).isin(" ", "A"))
    return kept.select(
        "structure_id",
        "atom_ord",
        part(22, 1).alias("chain_id"),
        F.try_to_number(part(23, 4), F.lit("S9999")).cast("int").alias("res_id"),
        part(27, 1).alias("insertion"),
        part(18, 3).alias("res_name"),
        part(13, 4).alias("atom_name"),
        part(77, 2).alias("element"),
        *(F.expr(f"try_cast(trim(substring(line, {start}, 8)) as double)").alias(axis) for axis, start in (("x", 31), ("y", 39), ("z", 47))),
        (record == "HETATM").alias("hetero"),
    )


_CIF_WORD = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""")


def _cif_values(lines: Iterator[str]) -> Iterator[str | None]:
    """Values of a loop, one by one wherever lines break, up to what follows it; None for ``.`` and ``?``."""
    for line in lines:
        if line.startswith(";"):
            text, line = [line[1:]], ""
            for rest in lines:
                if rest.startswith(";"):
                    line = rest[1:]
                    break
                text.append(rest)
            yield "\n".join(text).strip()
        line = line.strip()
        if line.startswith(("#", "_", "loop_", "data_")):
            return
        for single, double, plain in _CIF_WORD.findall(line):
            yield None if plain in (".", "?") else single or double or plain


def _number(text: str | None, kind: type) -> float | int | None:
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


def cif_record(names: list[str], cells: list[str | None]) -> tuple[str, str | None, tuple]:
    """(model, alternative location, values in the columns of RAW_SCHEMA after the ordinal) of one row of the loop.

    Unreadable or missing numbers are null, as in the other format, and a row that ends early has nulls for the rest.
    """
    row = dict(zip_longest(names, cells))
    pick = lambda *keys: next((row[k] for k in keys if row.get(k) is not None), "")
    place = [_number(row.get(f"Cartn_{axis}"), float) for axis in "xyz"]
    number = _number(pick("auth_seq_id", "label_seq_id"), int)
    fields = (pick("auth_asym_id", "label_asym_id"), number, pick("pdbx_PDB_ins_code"), pick("auth_comp_id", "label_comp_id"), pick("auth_atom_id", "label_atom_id"), pick("type_symbol"), *place, row.get("group_PDB") == "HETATM")
    return row.get("pdbx_PDB_model_num") or "1", row.get("label_alt_id"), fields


def _cif_rows(content: str) -> Iterator[tuple]:
    """Values of the atom_site loop of one mmCIF text, in the columns of RAW_SCHEMA after the id; the ordinal counts the rows of
    the loop from 1."""
    lines = iter(content.splitlines())
    names: list[str] = []
    for line in lines:
        if line.strip().startswith("_atom_site."):
            names.append(line.split()[0].removeprefix("_atom_site."))
        elif names:
            lines = chain([line], lines)
            break
    values = _cif_values(lines)
    first_model, ordinal = None, 0
    while names and (cells := list(islice(values, len(names)))):
        ordinal += 1
        model, alternative, fields = cif_record(names, cells)
        first_model = first_model or model
        if model == first_model and alternative in (None, "A"):
            yield ordinal, *fields


#: Line breaks of Python that are not those of files; texts that have one go row by row.
_ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_CIF_HEAD = re.compile(r"(?:^[^\S\n]*_atom_site\..*(?:\n|\Z))+", re.MULTILINE)
_CIF_END = re.compile(r"\n\s*(?:[#_]|loop_|data_)")
_CIF_TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'(?=\s|\Z)|"(?:[^"\n]|"(?=\S))*"(?=\s|\Z)|\S+""")
#: A quote that begins a value which does not end at the next white space.
_CIF_LOOSE = re.compile(r"""'(?<!\S')(?!\S*'(?!\S))|"(?<!\S")(?!\S*"(?!\S))""").search
#: Rows of several texts that go out together.
BATCH_ROWS = 10_000


def _cif_value(token: str) -> str | None:
    if token in (".", "?"):
        return None
    return token[1:-1] if token[0] in "'\"" and len(token) > 1 and token[-1] == token[0] else token


def _plain(tokens: list[str]) -> list[str | None]:
    """Tokens of a column without their quotes; None for ``.`` and ``?``."""
    changed = {t: v for t in set(tokens) if (v := _cif_value(t)) != t}
    return [changed.get(t, t) for t in tokens] if changed else tokens


def _cif_columns(content: str) -> list[list]:
    """The columns of what ``_cif_rows`` gives. Values of a plain loop are split at once and taken by their place in the row;
    text fields and odd line breaks go row by row."""
    content = content.replace("\r\n", "\n")
    head = _CIF_HEAD.search(content)
    if head is None:
        return []
    end = _CIF_END.search(content, head.end() - 1)
    block = content[head.end() : end.start() if end else len(content)]
    if block.startswith(";") or "\n;" in block or any(c in content for c in _ODD_BREAKS):
        return [list(c) for c in zip(*_cif_rows(content), strict=True)]
    tokens = _CIF_TOKEN.findall(block) if _CIF_LOOSE(block) else block.split()
    names = [line.split()[0].removeprefix("_atom_site.") for line in head[0].splitlines()]
    width, n = len(names), -(-len(tokens) // len(names))
    if not n:
        return []
    place, missing = {name: k for k, name in enumerate(names)}, [None] * n

    def column(name: str) -> list[str | None]:
        if name not in place:
            return missing
        found = _plain(tokens[place[name] :: width])
        return found + missing[len(found) :]

    def pick(*keys: str) -> list[str | None]:
        first, *rest = [column(k) for k in keys if k in place] or [missing]
        for other in rest:
            first = [a if a is not None else b for a, b in zip(first, other, strict=True)]
        return first

    def numbers(kind: type, *keys: str) -> list:
        first = next((k for k in keys if k in place), None)
        if first is not None and len(tokens) == n * width:
            try:
                return list(map(kind, tokens[place[first] :: width]))
            except ValueError:
                pass
        return [_number(c, kind) for c in pick(*keys)]

    def words(*keys: str) -> list[str]:
        first = pick(*keys)
        return [a if a is not None else "" for a in first] if None in first else first

    columns = [
        list(range(1, n + 1)), words("auth_asym_id", "label_asym_id"), numbers(int, "auth_seq_id", "label_seq_id"), words("pdbx_PDB_ins_code"), words("auth_comp_id", "label_comp_id"),
        words("auth_atom_id", "label_atom_id"), words("type_symbol"), *(numbers(float, f"Cartn_{axis}") for axis in "xyz"), [g == "HETATM" for g in column("group_PDB")],
    ]
    models = [m or "1" for m in column("pdbx_PDB_model_num")]
    kept = [m == models[0] and a in (None, "A") for m, a in zip(models, column("label_alt_id"), strict=True)]
    if all(kept):
        return columns
    return [list(compress(c, kept)) for c in columns] if any(kept) else []


def cif_atoms(texts: DataFrame) -> DataFrame:
    """Raw atom rows of mmCIF text: first model, alternative location none or A."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 3, pa.bool_()]
        names = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
        held: list[list] = [[] for _ in kinds]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names=names)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for sid, content in zip(batch.column("structure_id").to_pylist(), batch.column("content"), strict=True):
                columns = _cif_columns(content.as_py() or "")
                if columns:
                    for c, more in zip(held, [[sid] * len(columns[0]), *columns], strict=True):
                        c += more
                if len(held[0]) >= BATCH_ROWS:
                    yield flush()
        if held[0]:
            yield flush()

    return texts.select("structure_id", "content").mapInArrow(parsed, RAW_SCHEMA)


def with_runs(rows: DataFrame, keys: list[str], order: str, partition: str = "structure_id", name: str = "run_id") -> DataFrame:
    """Number contiguous runs of equal ``keys`` from 1 in the order of ``order`` (gaps and islands)."""
    in_order = Window.partitionBy(partition).orderBy(order)
    changed = F.when(F.lag(F.struct(*keys)).over(in_order).eqNullSafe(F.struct(*keys)), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(in_order).cast("int")).drop("_changed")


def classified_runs(raw: DataFrame) -> DataFrame:
    """Raw atom rows with ``residue_ord``, ``water`` and ``modality``: contiguous runs are residues and are classified.

    The number of atoms that tells ions from ligands counts rows before repeated names are merged.
    """
    keys = [k for k in ("chain_id", "res_id", "insertion", "res_name") if k in raw.columns]
    runs = with_runs(raw, keys, "atom_ord", name="residue_ord").withColumns({"res_name": F.trim("res_name"), "water": F.trim("res_name").isin(WATERS)})
    in_run = Window.partitionBy("structure_id", "residue_ord")
    return runs.withColumn("modality", classify_residue(F.col("res_name"), F.max("hetero").over(in_run), F.count(F.lit(1)).over(in_run)))


def residues_of(raw: DataFrame) -> DataFrame:
    """The atom relation from raw rows: residues without waters. An element that is not given is the first letter of the atom
    name."""
    element = F.when(F.coalesce(F.trim("element"), F.lit("")) == "", infer_element(F.col("atom_name"))).otherwise(normalize_element(F.trim("element")))
    runs = classified_runs(raw).filter(~F.col("water"))
    place = [F.trim("atom_name").alias("atom_name"), element.alias("element"), "x", "y", "z"]
    return runs.select("structure_id", "residue_ord", "chain_id", F.col("res_id").alias("res_index"), "res_name", "modality", "hetero", "atom_ord", *place)


def parse_structures(texts: DataFrame) -> DataFrame:
    """The atom relation of (structure_id, format, content) rows; format cif is mmCIF, anything else PDB."""
    return residues_of(raw_atoms(texts))


def raw_atoms(texts: DataFrame) -> DataFrame:
    """Raw atom rows of (structure_id, format, content) texts; format cif is mmCIF, anything else PDB."""
    return pdb_atoms(texts.filter(F.col("format") != "cif")).unionByName(cif_atoms(texts.filter(F.col("format") == "cif")))


def parse_status(texts: DataFrame) -> DataFrame:
    """(structure_id, n_atoms, status, reason) of every text: ``ok``, or ``damaged`` or ``failed`` with a reason.

    A failed structure gives no tokens: it has no atoms, waters only, or a polymer residue without a vocabulary. A damaged one
    has atom rows whose numbers cannot be read; they are kept with nulls. Texts are parsed once.
    """
    return status_of(texts.select("structure_id").distinct(), raw_atoms(texts))


def status_of(ids: DataFrame, raw: DataFrame) -> DataFrame:
    """``parse_status`` of the structures ``ids`` from their raw atom rows, which are dealt by structure once."""
    bad = F.greatest(*(F.col(c).isNull() for c in ("x", "y", "z", "res_id")))
    strange = F.col("modality").isin(MODALITIES[:3]) & atom_slots(F.col("res_name")).isNull() & ~F.col("water")
    counts = classified_runs(raw).groupBy("structure_id").agg(
        F.count_if(~F.col("water")).alias("n_atoms"), F.count_if(~F.col("water") & bad).alias("n_bad"), F.min(F.when(strange, F.col("res_name"))).alias("unknown")
    )
    found = ids.join(counts, "structure_id", "left")
    failed = (
        F.when(F.col("n_atoms").isNull(), F.lit("no atom records"))
        .when(F.col("n_atoms") == 0, F.lit("waters only"))
        .when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown polymer residue: "), F.col("unknown")))
    )
    damage = F.when(F.col("n_bad") > 0, F.concat(F.lit("atom rows with unreadable numbers: "), F.col("n_bad").cast("string")))
    status = F.when(failed.isNotNull(), "failed").when(damage.isNotNull(), "damaged").otherwise("ok")
    return found.select("structure_id", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), status.alias("status"), F.coalesce(failed, damage).alias("reason"))


def from_atom_array(rows: DataFrame) -> DataFrame:
    """The atom relation of atom rows (structure_id, atom_ord, chain_id, res_id, res_name, atom_name, element, x, y, z, hetero)."""
    missing = {"structure_id", "atom_ord", "chain_id", "res_id", "res_name", "atom_name", "element", "x", "y", "z", "hetero"} - set(rows.columns)
    if missing:
        raise ValueError(f"atom rows lack {sorted(missing)}")
    return residues_of(rows)


def largest_chain(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain_id) of the chain with most residues; ties go to the first name."""
    counts = atoms.groupBy("structure_id", "chain_id").agg(F.count_distinct("residue_ord").alias("n_residues"))
    return counts.groupBy("structure_id").agg(F.min(F.struct((-F.col("n_residues")).alias("least"), "chain_id")).alias("best")).select("structure_id", "best.chain_id", (-F.col("best.least")).alias("n_residues"))


def restrict_to_largest_chain(atoms: DataFrame) -> DataFrame:
    return atoms.join(largest_chain(atoms).drop("n_residues"), ["structure_id", "chain_id"], "left_semi")
