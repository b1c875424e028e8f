"""Scalar functions of the trace format, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
# The base-40 alphabet of file names; its first character ends a name.
BASE40 = "\0" + "0123456789abcdefghijklmnopqrstuvwxyz./-"


def zigzag(v: Column) -> Column:
    """Signed to unsigned (the same 64 bits): 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(F.negate(u.bitwiseAND(F.lit(1).cast("long"))))


def varint_size(u: Column) -> Column:
    """The bytes of an unsigned LEB128 number: 1 for 0 to 127, one more for every 7 bits."""
    bits = F.length(F.regexp_replace(F.bin(u), "^0+(?=.)", ""))
    return F.ceil(bits / F.lit(7)).cast("int")


def varint(u: Column) -> Column:
    """The LEB128 bytes of an unsigned number, as upper-case hex."""
    low = lambda i: F.shiftrightunsigned(u, 7 * i).bitwiseAND(F.lit(127).cast("long"))
    size = varint_size(u)
    parts = [F.when(F.lit(i) < size, F.lpad(F.hex(low(i) + F.when(F.lit(i + 1) < size, F.lit(128)).otherwise(F.lit(0))), 2, "0")).otherwise(F.lit("")) for i in range(10)]
    return F.concat(*parts)


def unvarint(hexed: Column) -> Column:
    """The number of a LEB128 encoding in hex, below 2^63."""
    digits = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(hexed, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shift")),
        lambda a, d: F.struct((a["sum"] + F.call_function("shiftleft", d.bitwiseAND(F.lit(127).cast("long")), a["shift"])).alias("sum"), (a["shift"] + 7).alias("shift")),
    )
    return total["sum"]


def base40(name: Column) -> Column:
    """Up to 12 characters as an unsigned number; others count as the end mark."""
    code = lambda i: F.greatest(F.instr(F.lit(BASE40[1:]), F.substring(name, i + 1, 1)) * F.when(F.length(name) > i, 1).otherwise(0), F.lit(0))
    return sum((code(i).cast(U64) * F.lit(str(40**i)).cast("decimal(20,0)") for i in range(12)), F.lit(0).cast(U64)).cast(U64)


def unbase40(value: Column) -> Column:
    """The name of a base-40 number, without the end marks after it."""
    chars = []
    for i in range(12):
        rest = F.call_function("div", value.cast(U64), F.lit(str(40**i)).cast(U64)) if i else value.cast(U64)
        digit = (rest % 40).cast("int")
        chars.append(F.when(digit > 0, F.substring(F.lit(BASE40[1:]), digit, F.lit(1))).otherwise(F.lit("")))
    return F.concat(*chars)


def unpack_gli(gli: Column) -> tuple[Column, Column]:
    """The high and the low 32 bits."""
    return F.shiftrightunsigned(gli, 32), gli.bitwiseAND(F.lit(0xFFFFFFFF))


def uuid7_ms(text: Column) -> Column:
    """The epoch milliseconds of a UUIDv7."""
    return F.conv(F.substring(F.replace(text, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def uuid_text(data: Column) -> Column:
    h = F.lower(F.hex(data))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def home_shard(key: Column, shards: int) -> Column:
    """(key * 2654435761 mod 2^64) mod shards, exact for keys below 2^63."""
    product = key.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)")
    return (product % F.lit("18446744073709551616").cast("decimal(20,0)") % F.lit(shards)).cast("int")


def pool_size(pool_class: Column) -> Column:
    return F.call_function("shiftleft", F.lit(32), pool_class.cast("int"))


def pool_class(size: Column) -> Column:
    """The least class whose slots hold a size and whose used-bytes field can say it; 6 at most."""
    out = F.lit(6)
    for c in range(5, -1, -1):
        out = F.when((size <= 32 << c) & (size <= (1 << 5 + c) - 1), F.lit(c)).otherwise(out)
    return out


def pack_slot(block: Column, cls: Column, slot: Column, used: Column) -> Column:
    """Block number, class, slot and used bytes in one number; the used bytes have 5 bits and one more for each class."""
    own = F.call_function("shiftleft", slot.cast("long"), (cls + 5).cast("int")).bitwiseOR(used.cast("long"))
    return F.shiftleft(block.cast("long"), 15).bitwiseOR(F.shiftleft(cls.cast("long"), 12)).bitwiseOR(own)


def unpack_slot(raw: Column) -> tuple[Column, Column, Column, Column]:
    """Block number, class, slot and used bytes."""
    cls = F.shiftright(raw, 12).bitwiseAND(F.lit(7)).cast("int")
    low = raw.bitwiseAND(F.lit(0xFFF))
    slot = F.call_function("shiftright", low, cls + 5)
    return F.shiftright(raw, 15), cls, slot, low - F.call_function("shiftleft", slot, cls + 5)


# Ordinals of I/O kinds.
_IO = {"stdout": 0, "stderr": 12, "file": 4, "error": 11}


def io_ordinal(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in _IO.items():
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out


def io_kind(ordinal: Column) -> Column:
    """The coarse kind of an ordinal; unknown ones are stdout."""
    return F.when(ordinal.between(3, 10), "file").when(ordinal == 11, "error").when(ordinal.isin(12, 13), "stderr").otherwise("stdout")


# Names of OS events by number.
OS_EVENTS = "Write WriteFile Read ReadFile Open Close Mmap Socket Connect Accept Send Recv Poll ClockGettime Getrandom".split()


def os_event_name(kind: Column) -> Column:
    names = F.array(*[F.lit(f"elk{x}") for x in OS_EVENTS])
    return F.coalesce(F.get(names, kind.cast("int")), F.concat(F.lit("elk_unknown_"), kind.cast("string")))


# Names of native events by number.
NATIVE_EVENTS = {
    0: "evSyncLockAcquireBegin evSyncLockAcquireSuccess evSyncLockRelease evSyncCvWaitBegin evSyncCvWaitEnd evSyncCvSignal evSyncCvBroadcast "
    "evSyncSemWaitBegin evSyncSemWaitEnd evSyncSemPost evSyncEventWaitBegin evSyncEventWaitEnd evSyncEventSet evSyncEventReset evSyncAtomicRmw "
    "evSyncAtomicFence evSyncAtomicLoadAcquire evSyncAtomicStoreRelease evOsSyscall evOsRead evOsWrite evOsOpen evOsClose evOsMmap evOsPoll "
    "evOsSelect evOsSocket evOsConnect evOsAccept evOsSend evOsRecv evTimeClockGettime evTimeGettimeofday evRandGetrandom evRandGetentropy "
    "evThreadStart evThreadEnd evThreadJoin evCheckpointPeriodic evCheckpointCrash evCheckpointUser evProcessFork evProcessExec evData "
    "evRegisterSnapshot evOsLoadLibrary evOsGetCurrentProcessor evSyncTryLockAcquire evOsCreateEvent evOsCreateFileMapping evVerifyArgHash "
    "evVerifyMemHash evVerifyRegSnapshot evOsWait evOsSleep evOsIocp evOsGetAffinity",
    60: "evGfxGeneric evGfxDrawCall evGfxPresent evGfxResourceCreate evGfxDataUpload",
    70: "evVkGeneric evVkDraw evVkPresent evVkResourceCreate evVkDataUpload",
    80: "evTraceContextSpanStart evTraceContextSpanEnd",
    90: "evReplayBlockForever",
}


def native_event_name(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for first, names in NATIVE_EVENTS.items():
        out = F.coalesce(out, F.get(F.array(*[F.lit(n) for n in names.split()]), (number - first).cast("int")))
    return F.coalesce(out, F.concat(F.lit("ev_unknown_"), number.cast("string")))


def state(value: Column, known: tuple[str, ...]) -> Column:
    """A known state; any other raises an error."""
    return F.when(value.isin(*known), value).otherwise(F.raise_error(F.concat(F.lit("unknown state "), value)))


def split_name(index: Column) -> Column:
    """000000.ct, 000001.ct, ...; longer numbers aren't cut."""
    return F.concat(F.when(F.length(index.cast("string")) < 6, F.lpad(index.cast("string"), 6, "0")).otherwise(index.cast("string")), F.lit(".ct"))


def payload_json(payload: Column, printable: Column) -> Column:
    """JSON of a payload: its length, base64, and text if printable."""
    return F.to_json(F.struct(F.octet_length(payload).alias("len"), F.base64(payload.cast("binary")).alias("b64"), F.when(printable, payload.cast("string")).alias("text")))


def line_length(lengths: Column, index0: Column) -> Column:
    """A line's length by its number from 0; null out of range."""
    return F.get(lengths, index0)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))
