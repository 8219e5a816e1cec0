"""Socket events that source files declare, register, send or hear, from tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import extension
from lodestrata.operators.models import Members
from lodestrata.operators.structure import LANGUAGES
from lodestrata.runtime import ship_package

EVENT = "event_name string, direction string, typed boolean, ack boolean, source string, protocol string, payload string"
TO_SERVER, TO_CLIENT, BOTH = "CLIENT_TO_SERVER", "SERVER_TO_CLIENT", "BIDIRECTIONAL"
#: Endings of interfaces that declare events, objects that hear and send, and events of the transport itself.
DECLARED = {"ClientToServerEvents": TO_SERVER, "C2SEvents": TO_SERVER, "ServerToClientEvents": TO_CLIENT, "S2CEvents": TO_CLIENT}
HEARS, SENDS = ("socket", "io", "emitter"), ("socket", "io", "broadcast", "ws", "client")
SELECTS = ("to", "in", "of")
TRANSPORT = ("disconnect", "connect_error")
#: Parts of names of events that a server sends, of registered events and of those of rooms.
SENT_IF_REGISTERED = ("state", "result", "sync", "open", "closed", "update")
SENT_IN_ROOM = ("state", "ended", "countdown", "error", "broadcast")
#: What shows calls between browsers, and the events these use.
PEERS = ("rtcpeerconnection", "createoffer", "createanswer", "onicecandidate", "cloudflaresfu", "mediasoup", "livekit")
SIGNALS = ("webrtc:signal", "webrtc:offer", "webrtc:answer", "webrtc:candidate", "webrtc:ice-candidate", "sfu:join", "sfu:leave", "sfu:track")
CLIENT_PARTS = ("client", "frontend", "ui", "web", "components")


def read_events(path: str, content: str) -> list[tuple]:
    """(event, direction, typed, ack, source, protocol, payload) of one file, in order of what says most about an event."""
    ext = path.rsplit(".", 1)[-1].lower()
    m = Members(path, content, LANGUAGES.get(ext, "js"))
    r = m.r
    client = bool({p for part in path.lower().split("/") for p in part.replace("-", ".").replace("_", ".").split(".")} & set(CLIENT_PARTS))
    out: list[tuple] = []
    put = lambda name, direction, typed, ack=False, protocol="SOCKET_IO", payload=None: out.append((name, direction, typed, ack, path, protocol, payload))
    text = lambda i: r.word[i].strip("\"'`") if i < len(r.word) and r.kind[i] == "string" else None
    for i, w in enumerate(r.word):
        if w == "interface" and r.is_word(i + 1):
            direction = next((d for end, d in DECLARED.items() if r.word[i + 1].endswith(end)), None)
            body = r.body_after(i + 2, len(r.word)) if direction else None
            for k in range(body[0] + 1, body[1]) if body else ():
                if r.is_sign(k + 1, ":") and r.is_sign(k + 2, "(") and r.is_sign(r.partner.get(k + 2, k) + 1, "=>") and r.opening.get(body[1]) == body[0]:
                    given = m.text(k + 3, r.partner[k + 2])
                    put(r.word[k].strip("\"'`"), direction, True, any(a in given.lower() for a in ("ack", "callback")), payload=f"({given})")
        elif w == "socketEvents" and r.is_sign(i + 1, ":") and r.is_sign(i + 2, "["):
            for k in range(i + 3, r.partner.get(i + 2, i + 3)):
                if text(k):
                    put(text(k), TO_CLIENT if any(s in text(k) for s in SENT_IF_REGISTERED) else TO_SERVER, True, payload="ModulePayload")
        elif w in ("on", "emit", "OnEvent") and r.is_sign(i - 1, ".") and r.is_sign(i + 1, "(") and text(i + 2):
            at = i - 2
            if r.is_sign(at, ")") and r.word[r.opening.get(at, 1) - 1] in SELECTS:
                at = r.opening[at] - 3
            by = r.word[at].lstrip("@") if at >= 0 else ""
            if ext == "py" and by in ("sio", "socketio"):
                put(text(i + 2), TO_CLIENT if w == "emit" else TO_SERVER, False)
            elif ext == "go" and w == "OnEvent":
                named = i + 4 if r.is_sign(i + 3, ",") and text(i + 4) and text(i + 2).startswith("/") else i + 2
                put(text(named), TO_SERVER, False)
            elif ext not in ("py", "go") and w == "on" and by in HEARS and text(i + 2) not in TRANSPORT:
                put(text(i + 2), TO_CLIENT if client else TO_SERVER, False)
            elif ext not in ("py", "go") and w == "emit" and by in SENDS:
                put(text(i + 2), TO_SERVER if client else TO_CLIENT, False)
    if "room" in path:
        told = {e[0] for e in out}
        for i in range(len(r.word)):
            if (name := text(i)) and name.startswith("room:") and len(name) > 5 and name not in told:
                put(name, TO_CLIENT if any(s in name for s in SENT_IN_ROOM) else TO_SERVER, False, payload="RoomRuntimePayload")
                told.add(name)
    low = content.lower()
    if any(p in low for p in PEERS):
        told = {e[0] for e in out}
        for name in SIGNALS:
            if name in content and name not in told:
                put(name, BOTH, True, protocol="WEBRTC", payload="RTCSessionDescriptionInit | RTCIceCandidateInit")
    return out


def socket_events(files: DataFrame) -> DataFrame:
    """Events of all files, one row per place that speaks of one."""
    ship_package(files.sparkSession)
    names = [c.split()[0] for c in EVENT.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield pd.DataFrame([e for p, c in zip(b["path"], b["content"], strict=True) for e in read_events(p, c)], columns=names, dtype=object)

    hint = F.col("content").rlike(r"\.(?:on|emit|OnEvent)\s*\(|Events\b|socketEvents|room:|webrtc:|sfu:")
    mine = extension(F.col("path")).isin("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "cs")
    return files.where(mine & F.col("content").isNotNull() & hint).select("path", "content").distinct().mapInPandas(run, EVENT)


def of_protocol(events: DataFrame, protocol: str | None = None, direction: str | None = None) -> DataFrame:
    """Events of a protocol and a direction; those of both directions are of either."""
    if protocol is not None:
        events = events.where(F.col("protocol") == protocol)
    return events if direction is None else events.where(F.col("direction").isin(direction, BOTH))
