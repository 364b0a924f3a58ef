"""Schemas of the engine's tables and files."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {"LONG": T.LongType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType()}


def table(columns: str) -> T.StructType:
    """A schema of 'name TYPE, ...', made without a session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


READS = table("read_id LONG, header STRING, seq STRING, qual STRING")
CURVE_POINTS = table("x_obs DOUBLE, avg DOUBLE, sd DOUBLE, q1 DOUBLE, q2 DOUBLE, q3 DOUBLE")
CURVE_META = table("label STRING, version STRING, kernel STRING, maxL INT, L DOUBLE, AL DOUBLE, R LONG, overlap DOUBLE, divide DOUBLE, ksize INT")
REPLICATES = table("portion_idx INT, portion DOUBLE, replicate INT, redundancy DOUBLE")
SAMPLE_SHEET = table("File STRING, Name STRING, Col STRING")
TERM = table("id LONG, name STRING, term_type STRING, acc STRING, is_obsolete INT, is_root INT, is_relation INT")
GRAPH_PATH = table("id LONG, term1_id LONG, term2_id LONG, relationship_type_id LONG, distance INT, relation_distance INT")
TERM2TERM = table("id LONG, relationship_type_id LONG, term1_id LONG, term2_id LONG, complete INT")
TERM2TERM_METADATA = table("id LONG, relationship_type_id LONG, term1_id LONG, term2_id LONG")
TERM_SUBSET = table("term_id LONG, subset_id LONG")
ONTOLOGY = {"term": TERM, "graph_path": GRAPH_PATH, "term2term": TERM2TERM, "term2term_metadata": TERM2TERM_METADATA, "term_subset": TERM_SUBSET}
