"""Table schemas.

Identifiers (addresses, hashes, member ids) are BINARY: half the width of hex
text, and their byte order is the order the views sort by. Hex text appears
only in read results and JSON.
"""

from __future__ import annotations

from pyspark.sql import types as T

BYTES = T.BinaryType()
LONG = T.LongType()
INT = T.IntegerType()
TEXT = T.StringType()
BOOL = T.BooleanType()
STAMP = T.TimestampType()
UINT64 = T.DecimalType(20, 0)


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


# A log as the source delivers it; every field the chain may leave out of a
# pending log is nullable.
RAW_LOG = _table(
    ("event_id", LONG), ("chain_id", INT), ("address", BYTES),
    ("topics", T.ArrayType(BYTES)), ("data", BYTES), ("block_number", LONG),
    ("block_hash", BYTES), ("tx_hash", BYTES), ("log_index", LONG),
)

BLOCK = _table(
    ("chain_id", INT), ("number", LONG), ("hash", BYTES),
    ("parent_hash", BYTES), ("block_ts", LONG),
)

WATCHED = _table(
    ("chain_id", INT), ("address", BYTES), ("kind", TEXT),
    ("parent", BYTES), ("from_block", LONG),
)

CURSOR = _table(("chain_id", INT), ("contract", BYTES), ("next_block", LONG))

CHAIN_STATE = _table(("chain_id", INT), ("head", LONG), ("finalized", LONG))

INSTRUCTION = _table(
    ("row_id", LONG), ("chain_id", INT), ("cluster", BYTES), ("instruction_id", BYTES),
    ("nonce", LONG), ("target_members", T.ArrayType(BYTES)), ("expiry", LONG),
    ("salt", BYTES), ("ciphertext", BYTES), ("ciphertext_hash", BYTES),
    ("block_number", LONG), ("log_index", LONG), ("tx_hash", BYTES), ("removed", BOOL),
)

ACK = _table(
    ("row_id", LONG), ("chain_id", INT), ("cluster", BYTES), ("instruction_id", BYTES),
    ("job_id", BYTES), ("member_id", BYTES), ("status", T.ShortType()), ("seq", LONG),
    ("log_pointer", BYTES), ("summary", BYTES), ("block_number", LONG),
    ("log_index", LONG), ("tx_hash", BYTES), ("removed", BOOL),
)

HOLE = _table(
    ("chain_id", INT), ("cluster", BYTES), ("missing_nonce", LONG),
    ("highest_buffered", LONG), ("reason", TEXT), ("observed_at", LONG),
    ("resolved_at", LONG),
)

# Log columns around the decoded payload; the payload struct itself follows
# from the registered event specs.
EVENT_KEY = ["chain_id", "contract", "block_hash", "log_index"]
POSITION = ["block_number", "log_index"]
