"""Operators of a running strategy over streams: feature buffers, time stops, scoring, heartbeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


def live_features(bars: DataFrame, keep: int = 800, least: int = 50) -> DataFrame:
    """Features of each closed bar of a stream (symbol, t, o, h, l, c, v) from the last `keep` bars of its symbol, once `least` are there: ret_1, ret_5, atr14, rsi14, ema20_dist, tickvol_z.

    The buffer lives in the state store (bounded by `keep`). Bars of a batch go in order of time; one that is not later than the last one seen is passed over.
    """
    out = "symbol string, t timestamp, c double, ret_1 double, ret_5 double, atr14 double, rsi14 double, ema20_dist double, tickvol_z double"
    state = "last bigint, h array<double>, l array<double>, c array<double>, v array<double>"

    def features(h, low, c, v):
        import numpy as np

        d = np.diff(c)
        tr = np.maximum(h[1:] - low[1:], np.maximum(abs(h[1:] - c[:-1]), abs(low[1:] - c[:-1])))
        atr, up, dn = tr[-14:].mean(), np.clip(d[-14:], 0, None).mean(), np.clip(-d[-14:], 0, None).mean()
        w = (1 - 2 / 21) ** np.arange(len(c))[::-1]
        vz, sd = v[-50:], v[-50:].std(ddof=1)
        return c[-1] / c[-2] - 1, c[-1] / c[-6] - 1, atr, 100 - 100 / (1 + up / dn) if dn else None, (c[-1] - (w * c).sum() / w.sum()) / atr if atr else None, (vz[-1] - vz.mean()) / sd if sd else None

    def run(key, frames: Iterator, st) -> Iterator:
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values("t", kind="stable")
        last, h, low, c, v = (st.get[0], *(list(x) for x in st.get[1:])) if st.exists else (-1, [], [], [], [])
        rows = []
        for b in pdf.itertuples():
            at = int(b.t.value)
            if at <= last:
                continue
            last = at
            for buf, x in ((h, b.h), (low, b.l), (c, b.c), (v, b.v)):
                buf.append(float(x))
                del buf[:-keep]
            if len(c) >= max(least, 16):
                rows.append((key[0], b.t, c[-1], *features(*(np.array(x) for x in (h, low, c, v)))))
        st.update((last, h, low, c, v))
        if rows:
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    return bars.groupBy("symbol").applyInPandasWithState(run, out, state, "append", "NoTimeout")


def time_stops(events: DataFrame, hold: int) -> DataFrame:
    """Time stops of a stream of events (symbol, t, kind, id): kind `open` starts a position, `close` ends it, `bar` is a closed bar; after `hold` bars an open position is told to close (symbol, id, t), once.

    State per symbol: the open positions with the bars each has seen. Within a batch events go by time, bars before openings.
    """
    out = "symbol string, id bigint, t timestamp"
    state = "ids array<bigint>, held array<int>"

    def run(key, frames: Iterator, st) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(frames))
        pdf["k"] = pdf["kind"].map({"bar": 0, "close": 1, "open": 2})
        held = dict(zip(*st.get)) if st.exists else {}
        rows = []
        for e in pdf.sort_values(["t", "k", "id"], kind="stable").itertuples():
            if e.kind == "open":
                held[int(e.id)] = 0
            elif e.kind == "close":
                held.pop(int(e.id), None)
            else:
                held = {i: n + 1 for i, n in held.items()}
                rows += [(key[0], i, e.t) for i, n in held.items() if n >= hold]
                held = {i: n for i, n in held.items() if n < hold}
        st.update((list(held), list(held.values())))
        if rows:
            yield pd.DataFrame(rows, columns=["symbol", "id", "t"])

    return events.groupBy("symbol").applyInPandasWithState(run, out, state, "append", "NoTimeout")


def scored(stream: DataFrame, model_path: str) -> DataFrame:
    """Rows of a stream with `prob`, by a pipeline model that was saved at `model_path`."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    out = PipelineModel.load(model_path).transform(stream)
    return out.withColumn("prob", vector_to_array("probability")[1]).select(*stream.columns, "prob")


class Heartbeat(StreamingQueryListener):
    """Calls `tell(name, batch, rows, seconds)` for each progress report of a query, at most once in `every_s` seconds a query; also when it ends (batch -1)."""

    def __init__(self, tell: Callable, every_s: float = 300.0):
        self.tell, self.every, self.last = tell, every_s, {}

    def onQueryStarted(self, event):
        self.last[str(event.id)] = -1e18

    def onQueryProgress(self, event):
        import time

        p = event.progress
        if time.monotonic() - self.last.get(str(p.id), -1e18) >= self.every:
            self.last[str(p.id)] = time.monotonic()
            self.tell(p.name, p.batchId, p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(None, -1, 0, 0.0)
