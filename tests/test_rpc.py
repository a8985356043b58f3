"""Node responses into the live chain's input."""

import pathlib

import pytest
from pyspark.sql import functions as F

from logtide.functions import hexes, numbers
from logtide.plans import catalog
from logtide.sources import logs
from logtide.streaming import live
from tests.fixtures import CHAIN, a, m, topic0


def test_node_lines_are_read_once_for_logs_and_retractions(spark, folder):
    line = lambda n, removed: (
        '{"address":"0x%s","topics":["0x%s"],"data":"0x","blockNumber":"0x%x","blockHash":"0x%s","transactionHash":"0x%s","logIndex":"0x2"%s}\n' % (
            a(1).hex(), topic0("ClusterDestroyed").hex(), n, m(n).hex(), m(2).hex(), removed))
    with open(f"{folder}/logs.json", "w") as out:
        out.writelines([line(1, ""), line(2, ',"removed":false'), line(3, ',"removed":true'), line(4, ',"removed":null')])
    rows = spark.read.schema(logs.RPC_LOG).json(folder)
    once = live.rpc_inputs(rows, CHAIN)
    twice = live.inputs(logs.from_rpc_logs(rows, CHAIN), retracted=logs.retracted_blocks(rows, CHAIN))
    assert once.schema.simpleString() == twice.schema.simpleString()
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan(twice).count("json") == 2 and plan(once).count("json") == 1


@pytest.mark.parametrize("text, raw, number", [
    ("0x1f", b"\x1f", 31), ("1f", b"\x1f", None), ("0X1f", None, 31), ("0x", b"", None), ("", b"", None), (None, None, None), ("0x1", None, 1),
    ("0x0x1f", None, None), ("x0", None, None), ("0xzz", None, None), (" 0x1f ", None, 31), ("0x1f\n", None, 31), ("0x+1f", None, 31), ("0xé", None, None),
    ("0x7fffffffffffffff", b"\x7f" + b"\xff" * 7, 2**63 - 1), ("0x8000000000000000", b"\x80" + bytes(7), None),
    ("0x0000000000000000001f", bytes(9) + b"\x1f", 31), ("42", b"\x42", 42), ("-1", None, None)])
def test_text_of_nodes(spark, text, raw, number):
    rows = spark.createDataFrame([(text,)], "t string")
    got = rows.select(hexes.parse_bytes(F.col("t")), hexes.parse_fixed(F.col("t"), 1), numbers.parse_uint_as_int64(F.col("t"))).first()
    assert (None if got[0] is None else bytes(got[0])) == raw
    assert (None if got[1] is None else bytes(got[1])) == (raw if raw is not None and len(raw) == 1 else None)
    assert got[2] == number


def test_node_lines_are_sent_packed(spark, folder):
    """Hex text of hashes and zeros lies on the disk at a fraction of its length; readers need no notice."""
    lines = spark.range(2000).select(F.format_string("0x%064x", "id").alias("transactionHash"), F.lit(False).alias("removed")).coalesce(1)
    for _ in range(2):
        catalog._send(lines, folder)
    files = list(pathlib.Path(folder).glob("part-*"))
    assert len(files) == 2 and sum(f.stat().st_size for f in files) < 2000 * 2 * 30
    read = spark.read.schema(logs.RPC_LOG).json(folder)
    assert read.select("transactionHash").distinct().count() == 2000 and read.count() == 4000
