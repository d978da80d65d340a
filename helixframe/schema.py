"""Row layouts, and constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Strands, orientation-free names of overlap classes, and statistics constants.
FORWARD, REVERSE = 0, 1
LOCATIONS = ("Left", "Right", "Contained", "Equal", "Containing", "Abnormal")
MAD_TO_SD = 1.4826
MEAN_DEVIATION_TO_SD = 1.253

READS = T.StructType(
    [
        T.StructField("read_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("sub_head", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("quality", T.StringType()),
    ]
)

#: An overlap row: both reads' coordinates are half-open on the forward strand.
OVERLAP_COLUMNS = ("a_id", "b_id", "identity", "a_strand", "a_start", "a_end", "a_len", "b_strand", "b_start", "b_end", "b_len")
OVERLAPS = T.StructType([T.StructField(c, T.DoubleType() if c == "identity" else T.LongType()) for c in OVERLAP_COLUMNS])

CANDIDATE_COLUMNS = ("qid", "sid", "score", "qdir", "qbeg", "qend", "qoff", "qsize", "sdir", "sbeg", "send", "soff", "ssize")
CANDIDATES = T.StructType([T.StructField(c, T.LongType()) for c in CANDIDATE_COLUMNS])
