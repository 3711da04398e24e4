"""ST1-ST3, ST8: streaming flow features, idle-gap sessions, order and late rows.

``groupBy(shard).transformWithStateInPandas``: a shard is a hash of the conversation,
so one call of the processor brings a micro-batch's packets of many conversations at
once, and the update of their running statistics is one pass of array operations.

*Order.* With ``delay_seconds`` packets wait in map state, by time slot, until the
watermark has passed the slot's end: an event-time timer then releases the slot's packets
in the order (time, id). So files may come in any order within the delay. Without a
delay each micro-batch is sorted and processed as it comes; batches must then be in
time order.

*Late packets.* A packet behind the watermark can no longer be put in order. It is
not tracked but goes out as a row of kind ``late``, so that nothing is lost
unnoticed: kept + late + waiting = input.

*Sessions.* With ``idle_seconds`` a conversation that was silent for longer starts
anew: its statistics begin again with the next packet, wherever micro-batches end.
The session's last emission goes out as a row of kind ``session`` once its gap is
seen, or once the watermark has passed it; its state is dropped. This replaces the
tracker's FIFO eviction.

State of a conversation is one record of fixed size, with exact integer moments (sums of
squared gaps as 128 bits), so values don't depend on how packets are dealt to
micro-batches. A waiting packet takes some 60 bytes. One conversation's packets are
followed in one task. Packets come in, and are released and sorted, some ``RELEASE`` at a
time, and are computed in chunks of ``CHUNK``, so that a worker's memory depends neither on the
size of a micro-batch nor on how much waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from packetlens.operators.flows import CONV, MAX_HDR_LEVEL, MIN_DURATION_S, _prepared
from packetlens.schemas import FEATURES

LEVELS = MAX_HDR_LEVEL + 1
RELEASE = 200_000    # packets (some 100 bytes each) sorted together
CHUNK = 20_000       # packets computed together (some 4 kB each, most of it the running counts by level)
SEP = "\x1f"
_NONE, _BIG = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_LONGS = ["nF", "sumF", "sqF", "nB", "sumB", "nFB", "sumFB", "gF_n", "gF_sum", "gB_n", "gB_sum", "gFB_n", "gFB_sum"]
_TOPS = ["maxF", "maxB", "gF_max"]          # running maxima
_LOWS = ["minB", "minFB"]                   # running minima
_LASTS = ["lastF", "lastB", "lastFB"]       # last time of each role
STATE = np.dtype([("last_us", "<i8"), ("start_us", "<i8"), ("init_lo", "?"), ("replies", "<i8"),
                  *[(k, "<i8") for k in (*_LONGS, *_TOPS, *_LOWS, *_LASTS)], ("above", "<i8", (LEVELS,)),
                  ("gF_sq", "<u8", (2,)), ("gFB_sq", "<u8", (2,)),
                  ("emitted", "?"), ("e_pid", "<i8"), ("e_us", "<i8"), ("e_len", "<i8"), ("e_feats", "<f8", (len(FEATURES),))])

PACKET_ROWS = pa.schema([("conv", pa.string()), ("packet_id", pa.int64()), ("ts_us", pa.int64()), ("pkt_len", pa.int64()),
                         ("from_lo", pa.bool_()), ("hdr", pa.int64()), ("win", pa.int64())])

OUTPUT = T.StructType(
    [T.StructField("packet_id", T.LongType()), T.StructField("ts", T.TimestampType()),
     T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
     T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
     T.StructField("proto", T.IntegerType()), T.StructField("pkt_len", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in FEATURES])
TRACKED = T.StructType([T.StructField("kind", T.StringType()), *OUTPUT.fields])


def _fresh(n: int) -> np.ndarray:
    """Records of conversations without a packet."""
    s = np.zeros(n, STATE)
    for k in ("start_us", *_TOPS, *_LASTS):
        s[k] = _NONE
    for k in _LOWS:
        s[k] = _BIG
    return s


class _Segments:
    """Runs of rows that belong together, with running values inside each."""

    def __init__(self, starts: np.ndarray, n: int):
        self.n, self.first_of = n, starts
        self.last_of = np.append(starts[1:], n) - 1
        self.seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.first = starts[self.seg]
        self.place = np.arange(n) - self.first

    def sums(self, x: np.ndarray, prior: np.ndarray) -> np.ndarray:
        c = np.cumsum(x, axis=0)
        return c - (c - x)[self.first] + prior[self.seg]

    def tops(self, x: np.ndarray, prior: np.ndarray, op=np.maximum) -> np.ndarray:
        step, longest = 1, int(self.place.max(initial=0))
        while step <= longest:
            ahead = x.copy()
            ahead[step:] = np.where(self.place[step:] >= step, op(x[step:], x[:-step]), x[step:])
            x, step = ahead, step * 2
        return op(x, prior[self.seg])

    def last_time(self, ts: np.ndarray, mask: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Time of the last masked row up to each row (``_NONE``: there is none)."""
        at = np.maximum.accumulate(np.where(mask, np.arange(self.n), -1))
        return np.where(at >= self.first, ts[np.maximum(at, 0)], prior[self.seg])

    def before(self, x: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """``x`` of the row before in the run; ``prior`` at its start."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first_of] = prior
        return out


def _big(words: np.ndarray) -> np.ndarray:
    return words[:, 0].astype(object) * (1 << 64) + words[:, 1].astype(object)


def _std(n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Population deviation from exact integer moments."""
    spread = (n.astype(object) * s2 - s1.astype(object) * s1.astype(object)).astype(np.float64)
    return np.sqrt(np.maximum(spread, 0.0)) / np.maximum(n, 1)


def advance(seg: _Segments, p: dict[str, np.ndarray], state: np.ndarray, min_duration: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Continue ``state`` (one record a run) over the packets ``p``: the rows
    that emit, the 30 features of each, and the new state."""
    ts, ln, from_lo, hdr = p["ts_us"], p["pkt_len"], p["from_lo"], p["hdr"]
    new = state["start_us"] == _NONE
    state["start_us"] = np.where(new, ts[seg.first_of], state["start_us"])
    state["init_lo"] = np.where(new, from_lo[seg.first_of], state["init_lo"])
    is_init = from_lo == state["init_lo"][seg.seg]
    replies = seg.sums((~is_init).astype(np.int64), state["replies"])
    isF, isB = is_init & (replies == 0), ~is_init
    isFB = isF | isB
    zero = np.zeros(seg.n, np.int64)

    run = {"replies": replies}
    for role, mask in (("F", isF), ("B", isB), ("FB", isFB)):
        run[f"n{role}"] = seg.sums(mask.astype(np.int64), state[f"n{role}"])
        run[f"sum{role}"] = seg.sums(np.where(mask, ln, 0), state[f"sum{role}"])
        run[f"last{role}"] = seg.last_time(ts, mask, state[f"last{role}"])
        was = seg.before(run[f"last{role}"], state[f"last{role}"])
        has = mask & (was != _NONE)
        gap = np.where(has, ts - np.where(has, was, 0), 0)
        run[f"g{role}_n"] = seg.sums(has.astype(np.int64), state[f"g{role}_n"])
        run[f"g{role}_sum"] = seg.sums(gap, state[f"g{role}_sum"])
        if role != "B":
            run[f"g{role}_sq"] = seg.sums(gap.astype(object) * gap, _big(state[f"g{role}_sq"]))
        if role == "F":
            run["gF_max"] = seg.tops(np.where(has, gap, _NONE), state["gF_max"])
    run["sqF"] = seg.sums(np.where(isF, ln * ln, 0), state["sqF"])
    run["maxF"] = seg.tops(np.where(isF, ln, _NONE), state["maxF"])
    run["maxB"] = seg.tops(np.where(isB, ln, _NONE), state["maxB"])
    run["minB"] = seg.tops(np.where(isB, ln, _BIG), state["minB"], np.minimum)
    run["minFB"] = seg.tops(np.where(isFB, ln, _BIG), state["minFB"], np.minimum)
    level = np.floor_divide(ln - 1, 4)
    run["above"] = seg.sums((isF[:, None] & (level[:, None] >= np.arange(LEVELS))).astype(np.int64), state["above"])

    emit = np.flatnonzero(is_init & (run["nF"] >= 2))
    r = {k: v[emit] for k, v in run.items()}
    or0 = lambda x, none: np.where(x == none, 0, x)
    mean = lambda total, n: np.where(n > 0, total / np.maximum(n, 1), 0.0)
    us, own = 1e6, {"hdr": hdr[emit], "ts": ts[emit]}
    feats = {
        'Destination Port': p["dst_port"][emit],
        'Total Fwd Packets': r["nF"], 'Total Length of Fwd Packets': r["sumF"],
        'Fwd Packet Length Max': or0(r["maxF"], _NONE), 'Fwd Packet Length Mean': mean(r["sumF"], r["nF"]),
        'Fwd Packet Length Std': _std(r["nF"], r["sumF"], r["sqF"].astype(object)),
        'Bwd Packet Length Max': or0(r["maxB"], _NONE), 'Bwd Packet Length Min': or0(r["minB"], _BIG),
        'Bwd Packet Length Mean': mean(r["sumB"], r["nB"]),
        'Min Packet Length': or0(r["minFB"], _BIG), 'Packet Length Mean': mean(r["sumFB"], r["nFB"]),
        'Fwd Packets/s': r["nF"] / np.maximum((own["ts"] - state["start_us"][seg.seg[emit]]) / us, min_duration),
        'Fwd Header Length': own["hdr"], 'Fwd Header Length.1': own["hdr"],
        'Fwd IAT Total': r["gF_sum"] / us, 'Fwd IAT Mean': mean(r["gF_sum"], r["gF_n"]) / us,
        'Fwd IAT Std': _std(r["gF_n"], r["gF_sum"], r["gF_sq"]) / us, 'Fwd IAT Max': or0(r["gF_max"], _NONE) / us,
        'Bwd IAT Mean': mean(r["gB_sum"], r["gB_n"]) / us,
        'Flow IAT Std': _std(r["gFB_n"], r["gFB_sum"], r["gFB_sq"]) / us,
        'Average Packet Size': mean(r["sumFB"], r["nFB"]), 'Avg Fwd Segment Size': mean(r["sumF"], r["nF"]),
        'Avg Bwd Segment Size': mean(r["sumB"], r["nB"]),
        'Subflow Fwd Packets': r["nF"], 'Subflow Fwd Bytes': r["sumF"], 'Subflow Bwd Packets': r["nB"],
        'Down/Up Ratio': r["nB"] / np.maximum(r["nF"], 1),
        'Init_Win_bytes_forward': p["win"][emit], 'Init_Win_bytes_backward': zero[emit],
        'act_data_pkt_fwd': r["above"][np.arange(len(emit)), np.clip(own["hdr"] // 4, 0, LEVELS - 1)],
    }
    table = np.column_stack([np.asarray(feats[n], np.float64) for n in FEATURES]) if len(emit) else np.empty((0, len(FEATURES)))

    after = state.copy()
    for k, v in run.items():
        last = v[seg.last_of]
        if k.endswith("_sq"):
            after[k][:, 0] = np.array([x >> 64 for x in last], np.uint64)
            after[k][:, 1] = np.array([x & (2**64 - 1) for x in last], np.uint64)
        else:
            after[k] = last
    after["last_us"] = ts[seg.last_of]
    if len(emit):
        at = np.searchsorted(emit, seg.last_of, "right") - 1   # the run's last emission, if it has one
        has = (at >= 0) & (emit[np.maximum(at, 0)] >= seg.first_of)
        row = emit[at[has]]
        for k, v in (("e_pid", p["packet_id"][row]), ("e_us", ts[row]), ("e_len", ln[row]), ("e_feats", table[at[has]]), ("emitted", True)):
            after[k][has] = v
    return emit, table, after


def _rows(kind: str, conv: np.ndarray, from_lo: np.ndarray, pid, us, ln, feats: np.ndarray | None) -> pd.DataFrame:
    """Output rows; the endpoints are read back from the conversation's key."""
    parts = [c.split(SEP) for c in conv]
    ends = [(x[0], x[2], int(x[1]), int(x[3])) if lo else (x[2], x[0], int(x[3]), int(x[1])) for x, lo in zip(parts, from_lo)]
    src, dst, sport, dport = zip(*ends) if ends else ((), (), (), ())
    out = {"kind": [kind] * len(parts), "packet_id": np.asarray(pid, np.int64), "ts": pd.to_datetime(np.asarray(us, np.int64), unit="us", utc=True),
           "src_ip": list(src), "dst_ip": list(dst), "src_port": np.array(sport, np.int32), "dst_port": np.array(dport, np.int32),
           "proto": np.array([int(x[4]) for x in parts], np.int32), "pkt_len": np.asarray(ln, np.int32)}
    values = np.full((len(parts), len(FEATURES)), np.nan) if feats is None else feats
    out.update({n: values[:, i] for i, n in enumerate(FEATURES)})
    return pd.DataFrame(out)


class FlowTracker(StatefulProcessor):
    """Follows the conversations of one shard."""

    def __init__(self, emit: tuple[str, ...], min_duration: float, delayed: bool, slot_us: int, idle_us: int | None):
        self.emit, self.min_duration, self.delayed, self.slot_us, self.idle_us = emit, min_duration, delayed, slot_us, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getMapState("flows", "conv string", "state binary")
        if self.delayed:
            self.waiting = handle.getMapState("waiting", "slot long", "packets binary")
        if self.idle_us is not None:
            self.closing = handle.getMapState("closing", "slot long", "convs string")
        self.seen: dict = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came, n = [], 0
        for x in rows:
            came.append(pa.Table.from_pandas(x[PACKET_ROWS.names], PACKET_ROWS, preserve_index=False))
            n += len(x)
            if self.delayed and n >= RELEASE:
                yield from self.keep_waiting(pa.concat_tables(came), timerValues)
                came, n = [], 0
        if came:
            packets = pa.concat_tables(came)
            yield from self.keep_waiting(packets, timerValues) if self.delayed else self.track(packets)

    def keep_waiting(self, packets: pa.Table, timerValues) -> Iterator[pd.DataFrame]:
        ts = packets["ts_us"].to_numpy()
        late = ts < timerValues.getCurrentWatermarkInMs() * 1000
        if late.any():
            x = packets.filter(pa.array(late)).to_pandas()
            yield _rows("late", x.conv.to_numpy(), x.from_lo.to_numpy(), x.packet_id, x.ts_us, x.pkt_len, None)
            packets, ts = packets.filter(pa.array(~late)), ts[~late]
        slots = np.floor_divide(ts, self.slot_us)
        for slot in np.unique(slots).tolist():
            mine = packets.filter(pa.array(slots == slot))
            old = self.waiting.getValue((slot,))
            if old is None:
                self.wake_after(slot)
            else:
                mine = pa.concat_tables([pa.ipc.open_stream(bytes(old[0])).read_all(), mine])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PACKET_ROWS) as w:
                w.write_table(mine)
            self.waiting.updateValue((slot,), (sink.getvalue().to_pybytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.seen.get(key) == now:   # several timers of a shard ring at one watermark
            return
        self.seen[key] = now
        due = lambda state: sorted(s for (s,) in list(state.keys()) if (s + 1) * self.slot_us <= now)
        if self.delayed:
            held, n = [], 0
            for slot in due(self.waiting):
                held.append(pa.ipc.open_stream(bytes(self.waiting.getValue((slot,))[0])).read_all())
                self.waiting.removeKey((slot,))
                n += held[-1].num_rows
                if n >= RELEASE:
                    yield from self.track(pa.concat_tables(held))
                    held, n = [], 0
            if held:
                yield from self.track(pa.concat_tables(held))
        if self.idle_us is not None:
            for slot in due(self.closing):
                convs = self.closing.getValue((slot,))[0].split("\n")
                self.closing.removeKey((slot,))
                yield from self.close_idle(convs, (slot + 1) * self.slot_us)

    def wake_after(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.slot_us // 1000)

    def track(self, packets: pa.Table) -> Iterator[pd.DataFrame]:
        packets = packets.sort_by([("conv", "ascending"), ("ts_us", "ascending"), ("packet_id", "ascending")])
        for at in range(0, packets.num_rows, CHUNK):
            yield from self.track_sorted(packets.slice(at, CHUNK))

    def track_sorted(self, packets: pa.Table) -> Iterator[pd.DataFrame]:
        conv = np.array(packets["conv"].to_pylist(), object)
        p = {k: packets[k].to_numpy() for k in PACKET_ROWS.names[1:]}
        n = len(conv)
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))   # of conversations
        keys = conv[starts]
        held = _fresh(len(keys))
        for i, k in enumerate(keys):
            if (old := self.flows.getValue((k,))) is not None:
                held[i] = np.frombuffer(bytes(old[0]), STATE)[0]
        opens = np.zeros(n, bool)
        opens[starts] = True
        if self.idle_us is not None:
            before = np.append(0, p["ts_us"][:-1])
            before[starts] = np.where(held["start_us"] == _NONE, p["ts_us"][starts], held["last_us"])
            idle = p["ts_us"] - before > self.idle_us
            ended = idle[starts]
            yield from self.sessions(keys[ended], held[ended])
            held[ended] = _fresh(1)[0]
            opens |= idle
        seg = _Segments(np.flatnonzero(opens), n)
        # a conversation's first run goes on from its state, later ones begin anew
        which = np.searchsorted(starts, seg.first_of, "right") - 1
        state = _fresh(len(seg.first_of))
        goes_on = seg.first_of == starts[which]
        state[goes_on] = held[which[goes_on]]
        p["dst_port"] = np.array([int(c[3] if lo else c[1]) for c, lo in
                                  zip((k.split(SEP) for k in conv), p["from_lo"])], np.int64)
        if "kept" in self.emit:
            yield _rows("kept", conv, p["from_lo"], p["packet_id"], p["ts_us"], p["pkt_len"], None)
        emit, feats, after = advance(seg, p, state, self.min_duration)
        if "flow" in self.emit and len(emit):
            yield _rows("flow", conv[emit], p["from_lo"][emit], p["packet_id"][emit], p["ts_us"][emit], p["pkt_len"][emit], feats)
        last = np.append(which[1:] != which[:-1], True)   # the conversation's open run
        yield from self.sessions(keys[which[~last]], after[~last])
        for k, s in zip(keys[which[last]], after[last]):
            self.flows.updateValue((k,), (s.tobytes(),))
        if self.idle_us is not None:
            slots = np.floor_divide(after["last_us"][last] + self.idle_us, self.slot_us)
            for slot in np.unique(slots).tolist():
                old = self.closing.getValue((slot,))
                if old is None:
                    self.wake_after(slot)
                mine = [*([] if old is None else [old[0]]), *keys[which[last]][slots == slot]]
                self.closing.updateValue((slot,), ("\n".join(mine),))

    def sessions(self, keys: np.ndarray, states: np.ndarray) -> Iterator[pd.DataFrame]:
        """The last emissions of closed sessions."""
        has = states["emitted"]
        if "session" in self.emit and has.any():
            s = states[has]
            yield _rows("session", keys[has], s["init_lo"], s["e_pid"], s["e_us"], s["e_len"], s["e_feats"])

    def close_idle(self, convs: list[str], end_us: int) -> Iterator[pd.DataFrame]:
        keys, states = [], []
        for k in dict.fromkeys(convs):
            old = self.flows.getValue((k,))
            if old is not None and (s := np.frombuffer(bytes(old[0]), STATE))["last_us"][0] + self.idle_us < end_us:
                self.flows.removeKey((k,))
                keys.append(k)
                states.append(s)
                if len(keys) >= CHUNK:
                    yield from self.sessions(np.array(keys, object), np.concatenate(states))
                    keys, states = [], []
        if keys:
            yield from self.sessions(np.array(keys, object), np.concatenate(states))

    def close(self) -> None:
        pass


def _keep_state_in_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this provider; set where another one is."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get(name) != provider:
        spark.conf.set(name, provider)


def track_flows(packets: DataFrame, emit: tuple[str, ...] = ("flow",), delay_seconds: float | None = None,
                idle_seconds: float | None = None, slot_seconds: float = 60, shards: int = 64,
                min_duration: float = MIN_DURATION_S) -> DataFrame:
    """Rows of kind ``flow`` (emissions), ``session`` (closed sessions), ``kept`` (each
    tracked packet), as ``emit`` asks, and ``late`` (packets behind the watermark) from
    a streaming packet DataFrame."""
    from packetlens.session import ship_package
    spark = packets.sparkSession
    ship_package(spark)
    _keep_state_in_rocksdb(spark)
    timed = delay_seconds is not None
    if idle_seconds is not None and not timed:
        raise ValueError("idle_seconds needs delay_seconds: the watermark closes idle sessions")
    src = packets.withWatermark("ts", f"{int(delay_seconds * 1000)} milliseconds") if timed else packets
    prepared = _prepared(src)
    # the time travels as a number: late packets reach the tracker instead of being dropped
    rows = prepared.select(
        F.pmod(F.xxhash64(*CONV), F.lit(shards)).cast("int").alias("shard"), F.concat_ws(SEP, *[F.col(c).cast("string") for c in CONV]).alias("conv"),
        "packet_id", "ts_us", F.col("pkt_len").cast("long"), "from_lo", F.col("hdr").cast("long"),
        F.when(F.col("proto") == 6, F.coalesce("tcp_window", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("win"))
    tracker = FlowTracker(tuple(emit), min_duration, timed, max(1000, int(slot_seconds * 1000) * 1000),
                          None if idle_seconds is None else int(idle_seconds * 1e6))
    return rows.groupBy("shard").transformWithStateInPandas(tracker, TRACKED, "Append", "EventTime" if timed else "None")


def stream_flow_features(packets: DataFrame, delay_seconds: float | None = None, **options) -> DataFrame:
    """ST1: FL1 on a streaming packet DataFrame. With ``delay_seconds`` packets may
    come in any order within the delay; without, micro-batches are in time order."""
    out = track_flows(packets, ("flow",), delay_seconds, **options)
    return out.where("kind = 'flow'").drop("kind")


def stream_flow_summary(packets: DataFrame, idle_seconds: float, delay_seconds: float | None = None, **options) -> DataFrame:
    """ST2 + ST3: one row per closed session (a conversation silent for more than
    ``idle_seconds``): its last emission. The delay is the idle time unless given."""
    out = track_flows(packets, ("session",), idle_seconds if delay_seconds is None else delay_seconds, idle_seconds, **options)
    return out.where("kind = 'session'").drop("kind")
