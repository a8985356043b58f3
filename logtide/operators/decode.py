"""Raw logs to typed events as one projection over the log table.

An :class:`EventSpec` describes an event; the registry compiles to CASE
branches keyed on topic0, so decoding adds no join, no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions import hexes, numbers, payload as P

# Spark type of each ABI type inside the payload struct.
SPARK_TYPES = {
    "address": "binary",
    "bytes32": "binary",
    "bytes": "binary",
    "string": "string",
    "uint256": "string",
    "uint64": "decimal(20,0)",
    "uint8": "smallint",
    "bytes32[]": "array<binary>",
}
DYNAMIC = ("string", "bytes", "bytes32[]")


@dataclass(frozen=True)
class Arg:
    name: str
    abi: str
    indexed: bool = False


@dataclass(frozen=True)
class EventSpec:
    """A decoder plug-in: topic hash, kind and arguments in declaration order."""

    kind: str
    topic0: str
    args: tuple[Arg, ...]

    @property
    def signature(self) -> str:
        return f"{self.kind}({','.join(a.abi for a in self.args)})"


def _spec(kind: str, topic0: str, *args: str) -> EventSpec:
    parsed = []
    for arg in args:
        abi, *indexed, name = arg.split()
        parsed.append(Arg(name, abi, bool(indexed)))
    return EventSpec(kind, topic0, tuple(parsed))


# Event signatures and their topic hashes.
DEFAULT_SPECS = (
    _spec("ClusterDeployed", "48dc8dab67749a8c7da96c90843d5db72d2f30334a2f383d32844c69e5e505ff",
          "address indexed diamond", "address indexed deployer", "bytes32 indexed salt"),
    _spec("MemberRegistered", "d3a5ef464cdab77538c1e5b5b3b11966470c2d14eea2530781b7b5acdbd24d7d",
          "bytes32 indexed memberId", "address indexed instanceId",
          "address indexed passthrough", "string dnsLabel"),
    _spec("LeaderClaimed", "1cc8fd7fa2631332f03e6746d8fb30b0a0f4dc77a217c9b0b97dbaf68cbed46c",
          "bytes32 indexed memberId", "uint256 indexed epoch", "bytes endpoint"),
    _spec("PublicEndpointUpdated", "baf23e91ad88ee0491a442607ef77c0a0eaaba976b25af3d876f49c09e4e080f",
          "bytes32 indexed memberId", "bytes publicEndpoint"),
    _spec("MemberRetired", "e51e9b378281d16610c327ebbcab249ee690105506f1e70974f0122f2c67c212",
          "bytes32 indexed memberId", "uint256 timestamp"),
    _spec("ClusterDestroyed", "7cafe065744727f254e4b415d091881a85710901ee5a141ec7a52c6d537cbbaa",
          "uint256 timestamp"),
    _spec("ControlInstructionBroadcast", "9a022b3ed3fb2ac3ca6e3d5cadb1c9e26e2c4bb34fe02b1b6d13420cc6845863",
          "bytes32 indexed instructionId", "bytes32 indexed clusterId", "uint64 indexed nonce",
          "bytes32[] targetMembers", "uint64 expiry", "bytes32 salt", "bytes32 ciphertextHash",
          "bytes ciphertext"),
    _spec("ControlAck", "919398837b611cd4ec1a2d44949feda5e3894f63a88f039665b23ec7273771bc",
          "bytes32 indexed instructionId", "bytes32 indexed jobId", "bytes32 indexed memberId",
          "uint8 status", "uint64 seq", "bytes32 logPointer", "bytes summary"),
)


def registry(specs: Iterable[EventSpec] = DEFAULT_SPECS) -> tuple[EventSpec, ...]:
    """Specs with one entry per topic0; a later registration replaces an earlier one."""
    return tuple({s.topic0.lower(): s for s in specs}.values())


def payload_fields(specs: Iterable[EventSpec]) -> dict[str, str]:
    """Field name to ABI type over all specs."""
    fields: dict[str, str] = {}
    for arg in (a for s in specs for a in s.args):
        if SPARK_TYPES[fields.setdefault(arg.name, arg.abi)] != SPARK_TYPES[arg.abi]:
            raise ValueError(f"field {arg.name} is declared with two types")
    return fields


def payload_type(specs: Iterable[EventSpec] = DEFAULT_SPECS) -> str:
    fields = ",".join(f"{n}:{SPARK_TYPES[t]}" for n, t in payload_fields(specs).items())
    return f"struct<{fields}>"


# --- ABI words -------------------------------------------------------------

def _small(raw_word: Column) -> Column:
    """A word used as offset or length, below 2^31; NULL when it is larger or cut short."""
    return F.when(F.substring(raw_word, 1, 28) == F.lit(bytes(28)),
                  F.least(numbers.word_tail(raw_word, 4).cast("long"), F.lit(2**31 - 64)).cast("int"))


def _static(raw_word: Column, abi: str) -> Column:
    if abi == "address":
        return F.substring(raw_word, 13, 20)
    if abi == "bytes32":
        return raw_word
    if abi == "uint256":
        return numbers.uint256_text(raw_word)
    if abi == "uint64":
        return numbers.word_tail(raw_word, 8).cast("decimal(20,0)")
    if abi == "uint8":
        return numbers.word_tail(raw_word, 1).cast("short")
    raise ValueError(f"unsupported ABI type {abi}")


def _width(abi: str) -> int:
    return 32 if abi == "bytes32[]" else 1


@dataclass(frozen=True)
class _Layout:
    """Where one event keeps its arguments."""

    spec: EventSpec
    topics: tuple[Arg, ...]              # by topic, after topic0
    head: tuple[Arg, ...]                # by 32-byte slot of the data
    tails: tuple[tuple[int, Arg], ...]   # (slot, argument) of dynamic values

    @staticmethod
    def of(spec: EventSpec) -> _Layout:
        head = tuple(a for a in spec.args if not a.indexed)
        return _Layout(spec, tuple(a for a in spec.args if a.indexed), head,
                       tuple((i, a) for i, a in enumerate(head) if a.abi in DYNAMIC))

    def constants(self, tails: int) -> Column:
        slots = [self.tails[j][0] if j < len(self.tails) else None for j in range(tails)]
        widths = [_width(self.tails[j][1].abi) if j < len(self.tails) else None for j in range(tails)]
        return F.struct(
            F.lit(self.spec.kind).alias("_kind"), F.lit(32 * len(self.topics)).alias("_rest_bytes"),
            F.lit(32 * len(self.head)).alias("_head_bytes"),
            *[F.lit(v).cast("int").alias(f"_slot{j}") for j, v in enumerate(slots)],
            *[F.lit(v).cast("int").alias(f"_width{j}") for j, v in enumerate(widths)])

    def values(self) -> dict[str, Column]:
        """Field expressions over the word columns of :func:`_words`."""
        found = {a.name: _static(F.col(f"_topic{i}"), a.abi) for i, a in enumerate(self.topics)}
        found |= {a.name: _static(F.col(f"_head{i}"), a.abi)
                  for i, a in enumerate(self.head) if a.abi not in DYNAMIC}
        found |= {a.name: _tail(j, a.abi) for j, (_, a) in enumerate(self.tails)}
        return found


def _tail(j: int, abi: str) -> Column:
    """The j-th dynamic value of a row whose layout has been checked."""
    body, count, data = F.col(f"_offset{j}") + 33, F.col(f"_count{j}"), F.col("data")
    if abi == "bytes32[]":
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1))
        words = F.transform(steps, lambda i: F.substring(data, body + i * 32, F.lit(32)))
        return F.coalesce(words, F.array().cast("array<binary>"))
    raw = F.substring(data, body, count)
    return F.make_valid_utf8(raw.cast("string")) if abi == "string" else raw


def _case(branches: list[tuple[Column, Column]], dtype: str) -> Column:
    if not branches:
        return F.lit(None).cast(dtype)
    first, *more = branches
    return reduce(lambda acc, b: acc.when(*b), more, F.when(*first))


def computed(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with columns computed once, in a one-row generator.

    The optimizer copies a projected expression into every filter and field
    that uses it; a decoder built that way compiles to methods too long for the
    JIT. It does not copy through a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _fits(tails: int) -> Column:
    """The row is as long as its layout says."""
    size = F.octet_length("data")
    checks = [F.octet_length("topics_rest") >= F.col("_rest_bytes"), size >= F.col("_head_bytes")]
    for j in range(tails):
        end = F.col(f"_offset{j}").cast("long") + 32 + F.col(f"_count{j}").cast("long") * F.col(f"_width{j}")
        checks.append(F.col(f"_slot{j}").isNull() | F.coalesce(end <= size, F.lit(False)))
    return reduce(lambda a, b: a & b, checks)


@lru_cache(maxsize=32)
def _compiled(specs: tuple[EventSpec, ...]) -> tuple[list[Column], Column]:
    """(generator of each step, payload column) of a registry.

    Steps: layout constants, then topic words, head words and tail offsets,
    then tail counts, then the checked kind. Kept per registry, since building
    them costs hundreds of calls into the JVM and a micro-batch does it anew.
    """
    layouts = [_Layout.of(s) for s in specs]
    tails = range(max(len(x.tails) for x in layouts))
    constants = _case([(F.col("topic0") == F.lit(bytes.fromhex(x.spec.topic0)), x.constants(len(tails)))
                       for x in layouts], "")
    word = lambda source, start: F.substring(F.col(source), start, F.lit(32))
    words = [word("topics_rest", F.lit(32 * i + 1)).alias(f"_topic{i}")
             for i in range(max(len(x.topics) for x in layouts))]
    words += [word("data", F.lit(32 * i + 1)).alias(f"_head{i}")
              for i in range(max(len(x.head) for x in layouts))]
    words += [_small(word("data", F.col(f"_slot{j}") * 32 + 1)).alias(f"_offset{j}") for j in tails]
    counts = [_small(word("data", F.col(f"_offset{j}") + 1)).alias(f"_count{j}") for j in tails]
    kind = F.when(_fits(len(tails)), F.col("_kind")).alias("kind")
    values = [(x.spec.kind, x.values()) for x in layouts]
    columns = []
    for name, abi in payload_fields(specs).items():
        uses = [(F.col("kind") == k, found[name]) for k, found in values if name in found]
        columns.append(_case(uses, SPARK_TYPES[abi]).alias(name))
    payload = F.when(F.col("kind").isNotNull(), F.struct(*columns)).alias("decoded")
    steps = [F.inline(F.array(constants))]
    steps += [F.inline(F.array(F.struct(*c))) for c in (words, counts, [kind]) if c]
    return steps, payload


def with_payload(events: DataFrame, specs: Iterable[EventSpec] = DEFAULT_SPECS) -> DataFrame:
    """Set ``kind`` and ``decoded`` from topic0, topics_rest and data.

    Both are NULL, with the row kept, for an unknown topic0 or a log that does
    not fit its event's layout. Topics past those declared are ignored.
    """
    steps, payload = _compiled(registry(specs))
    rows = reduce(lambda df, step: df.select("*", step), steps, events)
    return rows.select(*events.columns, "kind", payload)


# --- raw logs --------------------------------------------------------------

def _reject_reason() -> Column:
    missing = ["block_number", "block_hash", "tx_hash", "log_index"]
    reason = reduce(
        lambda acc, c: acc.when(F.col(c).isNull(), F.lit(f"no {c}")), missing[1:],
        F.when(F.col(missing[0]).isNull(), F.lit(f"no {missing[0]}")))
    return (
        reason.when(F.coalesce(F.size("topics"), F.lit(0)) < 1, F.lit("first topic absent"))
        .when(F.col("log_index") > 2**31 - 1, F.lit("log_index beyond 31 bits"))
    )


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs that can be stored, logs lacking a required field with the reason)."""
    checked = raw.withColumn("reject_reason", _reject_reason())
    return (checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            checked.where(F.col("reject_reason").isNotNull()))


def normalise(logs: DataFrame) -> DataFrame:
    """Storable raw logs to event columns, topics past the first concatenated."""
    rest = F.concat(*[F.coalesce(F.get("topics", F.lit(i)), F.lit(hexes.EMPTY)) for i in (1, 2, 3)])
    return logs.select(
        "event_id", "chain_id", F.col("address").alias("contract"), "block_number", "block_hash",
        "log_index", "tx_hash", F.get("topics", F.lit(0)).alias("topic0"),
        rest.alias("topics_rest"), "data", F.lit(False).alias("removed"))


def decode_logs(raw: DataFrame, specs: Iterable[EventSpec] = DEFAULT_SPECS
                ) -> tuple[DataFrame, DataFrame]:
    """Raw logs to (events, rejects)."""
    good, rejects = split_rejects(raw)
    return with_payload(normalise(good), specs), rejects


def decode_late(events: DataFrame, specs: Iterable[EventSpec]) -> DataFrame:
    """Decode stored rows whose kind is NULL with a newer registry; others stay as they are.

    Rows with a kind are not decoded again. Their payload keeps every field it
    has, also those the newer registry no longer knows.
    """
    specs = registry(specs)
    known = {f.name: f.dataType for f in events.schema["decoded"].dataType.fields}
    fresh = with_payload(events.where(F.col("kind").isNull()).drop("kind", "decoded"), specs)
    types = known | {f.name: f.dataType for f in fresh.schema["decoded"].dataType.fields}

    def widened(rows: DataFrame) -> DataFrame:
        has = rows.schema["decoded"].dataType.fieldNames()
        fields = [(F.col(f"decoded.{n}") if n in has else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
        payload = F.when(F.col("kind").isNotNull(), F.struct(*fields))
        return rows.withColumn("decoded", payload).select(events.columns)

    return widened(events.where(F.col("kind").isNotNull())).unionByName(widened(fresh))


# --- JSON form -------------------------------------------------------------

def _render(value: Column, abi: str) -> Column:
    if abi in ("address", "bytes32", "bytes"):
        return hexes.hex0x(value)
    if abi == "bytes32[]":
        return F.transform(value, hexes.hex0x)
    return value if abi in ("string", "uint8") else value.cast("string")


def payload_json(kind: Column, decoded: Column, specs: Iterable[EventSpec] = DEFAULT_SPECS) -> Column:
    """The payload as JSON text with its topic hash and signature."""
    specs = registry(specs)
    fields = [_render(decoded[n], t).alias(n) for n, t in payload_fields(specs).items()]
    fields += [
        _case([(kind == s.kind, F.lit("0x" + s.topic0)) for s in specs], "string").alias("_topic0"),
        _case([(kind == s.kind, F.lit(s.signature)) for s in specs], "string").alias("_signature"),
    ]
    return F.when(kind.isNotNull(), F.to_json(F.struct(*fields)))


def _parse_field(document: Column, name: str, abi: str) -> Column:
    if abi == "uint8":
        return P.get_uint8(document, name)
    if abi == "bytes32[]":
        return P.get_bytes32_array(document, name)
    text = P.get_string(document, name)
    if abi == "uint64":
        return numbers.parse_uint64(text)
    if abi == "uint256":
        # stored text may be hex; the payload holds decimal text
        return F.coalesce(numbers.parse_uint_as_int64(text).cast("string"), text)
    if abi in ("address", "bytes32"):
        return hexes.parse_fixed(text, 20 if abi == "address" else 32, any_case_prefix=True)
    if abi == "bytes":
        return hexes.parse_bytes(text, any_case_prefix=True)
    return text


def payload_from_json(kind: Column, json_text: Column, specs: Iterable[EventSpec] = DEFAULT_SPECS,
                      strict: bool = False) -> Column:
    """JSON text back to the typed payload.

    Fields that do not parse become NULL, or fail the job when ``strict``.
    """
    specs = registry(specs)
    document = P.parse(json_text)
    columns = []
    for name, abi in payload_fields(specs).items():
        users = [s.kind for s in specs if any(a.name == name for a in s.args)]
        value = _parse_field(document, name, abi)
        if strict:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"payload field {name} does not parse"))
                           .cast(SPARK_TYPES[abi])).otherwise(value)
        columns.append(F.when(kind.isin(users), value).alias(name))
    return F.when(kind.isNotNull() & json_text.isNotNull(), F.struct(*columns))
