"""Where peptides stand in protein sequences, in time linear in a sequence's length."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.functions.exprs import fold_il


def spans(sequence: str, peptides: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(starts, ends, peptides) of all occurrences in one pass, overlapping ones too; places count from 0, an end lies after the last letter."""
    patterns = ahocorasick.Automaton()
    for p in peptides:
        if p:
            patterns.add_word(p, p)
    if not len(patterns):
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    patterns.make_automaton()
    found = list(patterns.iter(sequence))
    ends = np.fromiter((end for end, _ in found), np.int64, len(found)) + 1
    return ends - np.fromiter((len(p) for _, p in found), np.int64, len(found)), ends, [p for _, p in found]


def union_length(starts: np.ndarray, ends: np.ndarray, length: int) -> int:
    """How many places lie in any of the spans: openings and closings are summed up along the sequence."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return int((np.cumsum(change)[:length] > 0).sum())


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for sequence, peptides in zip(batch.column("sequence"), batch.column("peptides"), strict=True):
            text = sequence.as_py()
            starts, ends, _ = spans(text, peptides.as_py()) if peptides.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64), [])
            counts.append(union_length(starts, ends, len(text)))
        yield pa.record_batch([batch.column("key"), pa.array(counts, pa.int64()), pa.array([len(s.as_py()) for s in batch.column("sequence")], pa.int64())], ["key", "covered", "length"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, sequence, peptides in zip(batch.column("key").to_pylist(), batch.column("sequence"), batch.column("peptides"), strict=True):
            starts, ends, names = spans(sequence.as_py(), peptides.as_py() if peptides.is_valid else [])
            yield pa.record_batch([pa.array([key] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(starts), pa.array(ends)], ["key", "peptide", "start", "end"])


def _rows(rows: DataFrame, key: str, sequence: str, peptides: str) -> DataFrame:
    whole = rows.where(F.col(sequence).isNotNull())
    return whole.select(F.col(key).alias("key"), fold_il(F.col(sequence)).alias("sequence"), F.array_distinct(F.transform(peptides, fold_il)).alias("peptides"))


def coverage(rows: DataFrame, key: str = "accession", sequence: str = "sequence", peptides: str = "peptides") -> DataFrame:
    """(key, covered, length) of each row: residues under any occurrence of any of its peptides, I as L, overlaps once.

    ``peptides`` is an array of strings. A null sequence has no row, null peptides cover nothing.
    Each row is worked on alone, by one pass of a multi-pattern match over its sequence.
    """
    return _rows(rows, key, sequence, peptides).mapInArrow(_covered, "key string, covered long, length long").withColumnRenamed("key", key)


def occurrences(rows: DataFrame, key: str = "accession", sequence: str = "sequence", peptides: str = "peptides") -> DataFrame:
    """(key, peptide, start, end): every occurrence of each row's peptides in its sequence, places from 0, I as L."""
    return _rows(rows, key, sequence, peptides).mapInArrow(_places, "key string, peptide string, start long, end long").withColumnRenamed("key", key)
