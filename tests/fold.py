"""Plain rules of flow building on lists: the brute force the operators are tested against."""

from __future__ import annotations

COLUMNS = ("flow_key string, packet_id long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, "
           "protocol string, length int, syn boolean, fin boolean, rst boolean, ack boolean, psh boolean, "
           "seq long, ack_no long")


def packet(i, ts, a="10.0.0.1", b="10.0.0.2", ap=1000, bp=80, proto="TCP", length=60, flags="", seq=0, ack_no=0):
    one = "_".join([a, b, str(ap), str(bp), proto])
    two = "_".join([b, a, str(bp), str(ap), proto])
    return (min(one, two), i, ts, a, b, ap, bp, proto, length, "S" in flags, "F" in flags, "R" in flags,
            "A" in flags, "P" in flags, seq, ack_no)


def reply(i, ts, **more):
    return packet(i, ts, a="10.0.0.2", b="10.0.0.1", ap=80, bp=1000, **more)


def flows_of(rows, idle, age):
    """(key, first, last, n, bytes, reason, source) of every flow, in order per key."""
    out = []
    keys = sorted({r[0] for r in rows})
    for key in keys:
        live = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            _, _, ts, src, dst, _, _, proto, length, _, fin, rst, ack, _, seq, ack_no = r
            if live and ts - live["last"] >= idle:
                live["reason"] = "Inactivity Timeout"
                live = None
            elif live and ts - live["first"] >= age:
                live["reason"] = "Max Age Exceeded"
                live = None
            if live is None:
                live = {"key": key, "first": ts, "last": ts, "n": 0, "bytes": 0, "reason": "PCAP_DONE", "src": src,
                        "fin": {}, "acked": set(), "ts": []}
                out.append(live)
            live["last"] = ts
            live["n"] += 1
            live["bytes"] += length
            live["ts"].append(ts)
            ended = None
            if proto == "TCP":
                if fin:
                    live["fin"][src] = seq
                elif ack:
                    other = dst
                    if other in live["fin"] and ack_no == live["fin"][other] + 1:
                        live["acked"].add(other)
                if rst:
                    ended = "TCP RST"
                if len(live["acked"]) == 2:
                    ended = "TCP FIN"
            if ended and live["first"] == live["last"] == ts:
                live["reason"] = ended
                live = None
    return [(f["key"], f["first"], f["last"], f["n"], f["bytes"], f["reason"], f["src"]) for f in out]
