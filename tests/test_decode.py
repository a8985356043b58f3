import pytest
from pyspark.sql import functions as F

from logtide.functions import hexes, numbers, payload as P
from logtide.operators import control, decode
from tests.fixtures import a, decoded_json, m, raw_log, tail, topic0, w


def pad(raw: bytes) -> bytes:
    return raw.rjust(32, b"\0")


def hx(raw: bytes) -> str:
    return "0x" + raw.hex()


def test_each_event_decodes_to_its_payload(spark):
    targets = [m(1), m(2)]
    body = w(160) + w(77) + m(5) + m(6) + w(160 + 32 * 3) + w(2) + b"".join(targets) + tail(b"cipher")
    rows = raw_log(spark, [
        ([topic0("ClusterDeployed"), pad(a(9)), pad(a(8)), m(7)], b""),
        ([topic0("MemberRegistered"), m(1), pad(a(2)), pad(a(3))], w(32) + tail(b"abc1234567")),
        ([topic0("LeaderClaimed"), m(2), w(7)], w(32) + tail(bytes.fromhex("deadbeef000102"))),
        ([topic0("PublicEndpointUpdated"), m(3)], w(32) + tail(b"")),
        ([topic0("MemberRetired"), m(4)], w(2**256 - 1)),
        ([topic0("ClusterDestroyed")], w(1700000000)),
        ([topic0("ControlInstructionBroadcast"), m(1), m(2), w(2**64 - 1)], body),
        ([topic0("ControlAck"), m(1), m(2), m(3)], w(3) + w(9) + m(4) + w(128) + tail(b"ok")),
    ])
    events, rejects = decode.decode_logs(rows)
    assert rejects.isEmpty()
    found = decoded_json(events)
    for kind, payload in found:
        spec = next(s for s in decode.DEFAULT_SPECS if s.kind == kind)
        assert payload.pop("_topic0") == "0x" + spec.topic0
        assert payload.pop("_signature") == spec.signature
    assert found == [
        ("ClusterDeployed", {"diamond": hx(a(9)), "deployer": hx(a(8)), "salt": hx(m(7))}),
        ("MemberRegistered", {"memberId": hx(m(1)), "instanceId": hx(a(2)), "passthrough": hx(a(3)),
                              "dnsLabel": "abc1234567"}),
        ("LeaderClaimed", {"memberId": hx(m(2)), "epoch": "7", "endpoint": "0xdeadbeef000102"}),
        ("PublicEndpointUpdated", {"memberId": hx(m(3)), "publicEndpoint": "0x"}),
        ("MemberRetired", {"memberId": hx(m(4)), "timestamp": str(2**256 - 1)}),
        ("ClusterDestroyed", {"timestamp": "1700000000"}),
        ("ControlInstructionBroadcast", {
            "instructionId": hx(m(1)), "clusterId": hx(m(2)), "nonce": str(2**64 - 1),
            "targetMembers": [hx(t) for t in targets], "expiry": "77", "salt": hx(m(5)),
            "ciphertextHash": hx(m(6)), "ciphertext": hx(b"cipher")}),
        ("ControlAck", {"instructionId": hx(m(1)), "jobId": hx(m(2)), "memberId": hx(m(3)), "status": 3,
                        "seq": "9", "logPointer": hx(m(4)), "summary": hx(b"ok")}),
    ]


def test_logs_that_do_not_fit_keep_their_row(spark):
    empty_targets = w(160) + w(1) + m(1) + m(2) + w(192) + w(0) + tail(b"")
    rows = raw_log(spark, [
        ([bytes(32)], b""),                                              # unknown topic
        ([topic0("MemberRegistered"), m(1), pad(a(2))], w(32) + tail(b"x")),   # topic missing
        ([topic0("MemberRetired"), m(1)], b"\x01" * 31),                 # data cut short
        ([topic0("PublicEndpointUpdated"), m(1)], w(32) + w(33) + bytes(32)),  # length past the end
        ([topic0("PublicEndpointUpdated"), m(1)], w(2**200) + tail(b"x")),     # offset out of range
        ([topic0("PublicEndpointUpdated"), m(1)], w(2**31 - 1) + tail(b"x")),
        ([topic0("ControlInstructionBroadcast"), m(1), m(2), w(0)], empty_targets),
        ([topic0("MemberRegistered"), m(1), pad(a(2)), pad(a(3))], w(32) + tail(b"a\xffb")),
    ])
    events, _ = decode.decode_logs(rows)
    found = decoded_json(events)
    assert [k for k, _ in found] == [None] * 6 + ["ControlInstructionBroadcast", "MemberRegistered"]
    assert [p for _, p in found[:6]] == [None] * 6
    assert found[6][1]["targetMembers"] == []
    assert found[7][1]["dnsLabel"] == "a�b"


def test_rejects_name_the_missing_field(spark):
    good = raw_log(spark, [([topic0("ClusterDestroyed")], w(1))])
    for column, reason in [("block_number", "no block_number"), ("block_hash", "no block_hash"),
                           ("tx_hash", "no tx_hash"), ("log_index", "no log_index")]:
        damaged = good.withColumn(column, F.lit(None).cast(good.schema[column].dataType))
        kept, rejects = decode.split_rejects(damaged)
        assert kept.isEmpty() and rejects.first()["reject_reason"] == reason
    anonymous = good.withColumn("topics", F.array().cast("array<binary>"))
    assert decode.split_rejects(anonymous)[1].first()["reject_reason"] == "first topic absent"
    far = good.withColumn("log_index", F.lit(2**31))
    assert decode.split_rejects(far)[1].first()["reject_reason"] == "log_index beyond 31 bits"


def test_registry_last_wins_and_custom_event(spark):
    custom = decode.EventSpec("Renamed", topic0("ClusterDestroyed").hex(), (decode.Arg("at", "uint64"),))
    specs = decode.registry((*decode.DEFAULT_SPECS, custom))
    assert len(specs) == 8
    events, _ = decode.decode_logs(raw_log(spark, [([topic0("ClusterDestroyed")], w(5))]), specs)
    assert events.first()["kind"] == "Renamed" and events.first()["decoded"]["at"] == 5
    clash = decode.EventSpec("Clash", "ab" * 32, (decode.Arg("epoch", "address"),))
    with pytest.raises(ValueError, match="two types"):
        decode.payload_fields((*decode.DEFAULT_SPECS, clash))


def test_late_decode_leaves_known_rows_alone(spark):
    rows = raw_log(spark, [([topic0("ClusterDestroyed")], w(5)), ([topic0("MemberRetired"), m(1)], w(6))])
    old = [s for s in decode.DEFAULT_SPECS if s.kind == "ClusterDestroyed"]
    events, _ = decode.decode_logs(rows, old)
    assert [r["kind"] for r in events.orderBy("event_id").collect()] == ["ClusterDestroyed", None]
    later = decode.decode_late(events, decode.DEFAULT_SPECS).orderBy("event_id").collect()
    assert [r["kind"] for r in later] == ["ClusterDestroyed", "MemberRetired"]
    assert [r["decoded"]["timestamp"] for r in later] == ["5", "6"]


def test_late_decode_keeps_fields_the_newer_registry_lacks(spark):
    rows = raw_log(spark, [([topic0("ClusterDestroyed")], w(5)), ([topic0("LeaderClaimed"), m(1), w(1)], w(32) + tail(b""))])
    one = lambda kind: [s for s in decode.DEFAULT_SPECS if s.kind == kind]
    events, _ = decode.decode_logs(rows, one("ClusterDestroyed"))
    later = decode.decode_late(events, one("LeaderClaimed")).orderBy("event_id").collect()
    assert [r["kind"] for r in later] == ["ClusterDestroyed", "LeaderClaimed"]
    assert later[0]["decoded"]["timestamp"] == "5" and later[1]["decoded"]["epoch"] == "1"


def test_payload_json_parses_back_and_strict_mode_raises(spark):
    good = '{"memberId":"%s","epoch":"0x7","endpoint":"0x"}' % hx(m(1))
    bad = '{"memberId":"0x12","epoch":"7","endpoint":"0x"}'
    rows = spark.createDataFrame([("LeaderClaimed", good), ("LeaderClaimed", bad)], "kind string, j string")
    parse = lambda strict: decode.payload_from_json(F.col("kind"), F.col("j"), strict=strict)
    lenient = [r["d"] for r in rows.select(parse(False).alias("d")).collect()]
    assert (bytes(lenient[0]["memberId"]), lenient[0]["epoch"], lenient[1]["memberId"]) == (m(1), "7", None)
    with pytest.raises(Exception, match="payload field memberId does not parse"):
        rows.select(parse(True).alias("d")).collect()


def scalar(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("0x2a", 42), ("42", 42), ("0X2A", 42), (" 7\n", 7), ("0x", None), ("", None), ("-1", None),
    (str(2**63 - 1), 2**63 - 1), (str(2**63), None), ("0x7fffffffffffffff", 2**63 - 1),
    ("0x8000000000000000", None), ("0x" + "f" * 32, None), ("0x" + "0" * 60 + "5", 5), ("zz", None),
    (str(2**128 - 1), None)])
def test_uint_as_int64(spark, text, expected):
    assert scalar(spark, numbers.parse_uint_as_int64, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("0xdead", None), ("-1", None),
    ("", None), (" 1", None), ("0", 0), ("+5", 5), ("1.5", None)])
def test_uint64(spark, text, expected):
    assert scalar(spark, numbers.parse_uint64, text) == expected


@pytest.mark.parametrize("value", [0, 1, 2**64 - 1, 2**64, 10**18, 10**27 + 1, 2**128, 2**255, 2**256 - 1])
def test_uint256(spark, value):
    assert scalar(spark, numbers.uint256_text, w(value), "binary") == str(value)


@pytest.mark.parametrize("text, ok", [
    (hx(m(1)), True), (m(1).hex().upper(), True), ("0x12", False), ("0x" + "zz" * 32, False),
    ("0x" + "1" * 63, False), ("0X" + m(1).hex(), False)])
def test_fixed_bytes(spark, text, ok):
    assert (scalar(spark, lambda c: hexes.parse_fixed(c, 32), text) is not None) == ok


def test_variable_bytes_and_text(spark):
    assert scalar(spark, hexes.parse_bytes, "0x") == b""
    assert scalar(spark, hexes.parse_bytes, "0x123") is None
    assert scalar(spark, lambda c: hexes.parse_fixed(c, 32, True), "0X" + m(1).hex()) == m(1)
    for text, expected in [("0xff", "0xff"), ("0x6869", "hi"), ("plain", "plain"), ("0x", "")]:
        assert scalar(spark, hexes.hex_field_as_text, text) == expected


def test_json_fields(spark):
    body = '{"s":"x","n":5,"big":256,"neg":-1,"f":1.5,"empty":[],"good":["%s"],"bad":["%s","0x1"],"mixed":[1]}'
    rows = spark.createDataFrame([(body % (hx(m(1)), hx(m(1))),)], "j string")
    v = P.parse(F.col("j"))
    checks = {
        "s": (P.get_string(v, "s"), "x"), "n": (P.get_string(v, "n"), None),
        "gone": (P.field_error(v, "gone"), "missing"), "typed": (P.field_error(v, "n"), "not_string"),
        "fine": (P.field_error(v, "s"), None), "u8": (P.get_uint8(v, "n"), 5), "u8big": (P.get_uint8(v, "big"), None),
        "u8neg": (P.get_uint8(v, "neg"), None), "u8f": (P.get_uint8(v, "f"), None), "u8s": (P.get_uint8(v, "s"), None),
        "empty": (P.get_bytes32_array(v, "empty"), []), "good": (P.get_bytes32_array(v, "good"), [m(1)]),
        "bad": (P.get_bytes32_array(v, "bad"), None), "mixed": (P.get_bytes32_array(v, "mixed"), None),
        "notarray": (P.get_bytes32_array(v, "s"), None)}
    row = rows.select(*[c.alias(k) for k, (c, _) in checks.items()]).first()
    assert {k: row[k] for k in checks} == {k: e for k, (_, e) in checks.items()}


def test_values_past_int64_go_to_rejects(spark):
    body = w(160) + w(2**63) + m(5) + m(6) + w(192) + w(0) + tail(b"")
    rows = raw_log(spark, [
        ([topic0("ControlInstructionBroadcast"), m(1), m(2), w(3)], body),
        ([topic0("ControlAck"), m(1), m(2), m(3)], w(1) + w(9) + bytes(32) + w(128) + tail(b""))])
    events, _ = decode.decode_logs(rows)
    typed, rejects = control.instructions(events)
    assert typed.isEmpty() and rejects.count() == 1
    ack = control.acks(events)[0].first()
    assert (ack["log_pointer"], ack["summary"], ack["status"]) == (None, None, 1)
