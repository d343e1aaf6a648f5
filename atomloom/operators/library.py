"""Libraries of tokenised structures that are committed batch by batch, and targets that are loaded in waves.

A library folder holds a folder for each batch (``tokens``, ``ids``, ``outcomes``) and numbered manifests. A manifest lists the
batches that count; the next one is put in place by a rename that fails if another writer was first. What a manifest does not
list does not exist, so a batch that is cut short shows nothing, and of two writers one starts over.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.operators.dataset import load_targets, new_rows, ranked, within_size
from atomloom.operators.tokens import tokenize
from atomloom.sources.storage import names_in, put_new, read_small, remove, shared_dir, stored
from atomloom.sources.structures import list_structure_files, parse_structures, raw_atoms, residues_of, status_of

MANIFEST = re.compile(r"manifest-(\d{12})\.json")
#: The most files that one wave takes, whose paths go through the driver.
WAVE_FILES = 10_000


@dataclass(frozen=True)
class Manifest:
    """The batches of a library, in order: name, folder and counts of each."""

    version: int
    batches: tuple[dict, ...]


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The library's latest manifest; an empty one of version 0 if there is none."""
    versions = [int(m[1]) for name in names_in(spark, path) if (m := MANIFEST.fullmatch(name))]
    if not versions:
        return Manifest(0, ())
    return Manifest(max(versions), tuple(json.loads(read_small(spark, f"{path}/manifest-{max(versions):012d}.json"))["batches"]))


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    folders = [f"{path}/{b['folder']}/{part}" for b in manifest(spark, path).batches]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


TOKENS = "structure_id string, atom_idx int, residue_ord int, chain_id string, res_index int, res_name string, modality string, atom_name string, element string, is_virtual boolean, x double, y double, z double"


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of all structures of a library."""
    return _read(spark, path, "tokens", TOKENS)


def library_index(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id) of all structures of a library: sorted files with Bloom filters, beside the tokens."""
    return _read(spark, path, "ids", "structure_id string")


def library_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, n_atoms, status, reason) of every structure that was parsed for a library, failed ones included."""
    return _read(spark, path, "outcomes", "structure_id string, n_atoms long, status string, reason string")


def add_batch(spark: SparkSession, path: str, texts: DataFrame, batch: str) -> dict[str, int]:
    """Parse (structure_id, format, content) texts that the library lacks and commit them as ``batch``; returns how many were
    written, present and failed.

    Only the index is read to tell what is present. Texts are parsed once; tokens and outcomes come from what was parsed. A
    batch whose name is committed already does nothing and returns its counts, so a batch can be run again after a failure
    at any point. Of texts that share an id the parser takes the rows of all. Failed structures are tried again next time.
    """
    while True:
        now = manifest(spark, path)
        for b in now.batches:
            if b["batch"] == batch:
                return b["counts"]
        folder = f"batch-{uuid.uuid4().hex}"
        texts.select("structure_id").distinct().write.parquet(f"{path}/{folder}/asked")
        ids = spark.read.parquet(f"{path}/{folder}/asked")
        fresh = new_rows(ids, library_index(spark, path), "structure_id")
        fresh.write.parquet(f"{path}/{folder}/fresh")
        fresh = spark.read.parquet(f"{path}/{folder}/fresh")
        raw_atoms(texts.join(fresh, "structure_id", "left_semi")).write.parquet(f"{path}/{folder}/parsed")
        raw = spark.read.parquet(f"{path}/{folder}/parsed")
        status_of(fresh, raw).write.parquet(f"{path}/{folder}/outcomes")
        outcomes = spark.read.parquet(f"{path}/{folder}/outcomes")
        good = outcomes.filter(F.col("status") != "failed").select("structure_id")
        tokenize(residues_of(raw).join(good, "structure_id", "left_semi")).write.parquet(f"{path}/{folder}/tokens")
        good.sort("structure_id").write.option("parquet.bloom.filter.enabled#structure_id", "true").parquet(f"{path}/{folder}/ids")
        failed, written = outcomes.agg(F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") != "failed")).first()
        counts = {"written": written, "present": ids.count() - written - failed, "failed": failed}
        added = {"batch": batch, "folder": folder, "counts": counts}
        text = json.dumps({"batches": [*now.batches, added]})
        if put_new(spark, f"{path}/manifest-{now.version + 1:012d}.json", text):
            for part in ("asked", "fresh", "parsed"):
                remove(spark, f"{path}/{folder}/{part}")
            return counts
        remove(spark, f"{path}/{folder}")  # another writer was first


@dataclass(frozen=True)
class Loaded:
    """Tokens of the structures that were loaded, and how many candidates were looked at for them."""

    tokens: DataFrame
    examined: int


def load_in_waves(candidates: DataFrame, load: Callable[[DataFrame], DataFrame], n: int, max_atoms: int | None = None) -> Loaded:
    """Tokens of the first ``n`` of (structure_id, rank) candidates, by rank from 0, that load and have at most ``max_atoms``.

    ``load`` turns some of the candidates into tokens and leaves out those that fail. Waves of candidates double, up to
    WAVE_FILES, until enough have passed, so most are never loaded; the result is that of loading all. Candidates are ranked once.
    """
    spark = candidates.sparkSession
    out, low, size, passed, wave = shared_dir(spark, "waves"), 0, 2 * n, 0, 0
    candidates = stored(candidates, "candidates")
    total = candidates.count()
    folders = []
    while passed < n and low < total:
        size = max(1, min(size, WAVE_FILES))
        part = candidates.filter((F.col("rank") >= low) & (F.col("rank") < low + size))
        found = load(part)
        if max_atoms is not None:
            found = within_size(found, max_atoms)
        folders.append(f"{out}/{wave}")
        found.write.parquet(folders[-1])
        passed += spark.read.parquet(folders[-1]).select("structure_id").distinct().count()
        low, size, wave = low + size, 2 * size, wave + 1
    if not folders:
        return Loaded(load(candidates.limit(0)), 0)
    tokens = spark.read.parquet(*folders)
    seen = candidates.filter(F.col("rank") < low).select("structure_id", "rank")
    chosen = tokens.select("structure_id").distinct().join(seen, "structure_id").orderBy("rank").limit(n).select("structure_id")
    return Loaded(tokens.join(chosen, "structure_id", "left_semi"), min(low, total))


def file_tokens(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A loader of candidates whose ids are paths of structure files; only those files are opened."""

    def load(part: DataFrame) -> DataFrame:
        paths = [r[0] for r in part.select("structure_id").collect()]  # WAVE_FILES at most
        if not paths:
            return tokenize(parse_structures(spark.createDataFrame([], "structure_id string, format string, content string")))
        files = spark.read.format("binaryFile").load(paths)
        cif = F.lower("path").rlike(r"\.(cif|mmcif)$")
        return tokenize(parse_structures(files.select(F.col("path").alias("structure_id"), F.when(cif, "cif").otherwise("pdb").alias("format"), F.decode("content", "UTF-8").alias("content"))))

    return load


def shuffled(ids: DataFrame, seed: int, key: Column | None = None) -> DataFrame:
    """(structure_id, rank) of distinct ids in a seeded order, or in that of an integer ``key`` in [0, 2**32)."""
    by = F.pmod(F.xxhash64("structure_id", F.lit(seed)), F.lit(1 << 32)) if key is None else key
    return ranked(ids.select("structure_id").distinct(), by, "structure_id")


def training_targets(
    spark: SparkSession, n: int, max_atoms: int | None = None, seed: int = 0, library: str | None = None, directory: str | None = None, recursive: bool = False, listed: DataFrame | None = None
) -> Loaded:
    """``n`` targets from the first source that is given: a library, a directory of files, a list of files with their rank.

    The first two are shuffled by ``seed``, the list keeps its order. Structures that fail or are too large do not count.
    A source without candidates is an error; a library's structures are loaded without parsing.
    """
    if library is not None:
        tokens = read_library(spark, library)
        total = library_index(spark, library).count()
        if not total:
            raise ValueError(f"{library} has no structures")
        return Loaded(load_targets(tokens, n, max_atoms, seed), total)
    if directory is not None:
        candidates = shuffled(list_structure_files(spark, directory, recursive).select(F.col("path").alias("structure_id")), seed).persist()
    elif listed is not None:
        candidates = listed.select("structure_id", "rank")
    else:
        raise ValueError("there must be a library, a directory or a list")
    if not candidates.limit(1).count():
        raise ValueError("there are no structure files")
    found = load_in_waves(candidates, file_tokens(spark), n, max_atoms)
    candidates.unpersist()
    return found
