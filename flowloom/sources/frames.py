"""Ethernet frames to packet columns, many frames at a time over one byte buffer.

Headers are read with numpy at computed positions; only names inside payloads (requests, questions, client
hellos) are parsed one by one, for the packets that carry them. A frame that cannot be read is not dropped
but comes out with the reason in ``skipped``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Reasons why a frame yields no packet.
SHORT_FRAME, NOT_IP, SHORT_IP, SHORT_ARP, SHORT_TRANSPORT = "short_frame", "not_ip", "short_ip", "short_arp", "short_transport"
_TRANSPORTS = {6: "TCP", 17: "UDP", 1: "ICMP"}


def _texts(values: np.ndarray, valid: np.ndarray, text: Callable[[int], str]) -> pa.Array:
    """Texts of integers, written once per distinct value."""
    distinct, place = np.unique(values, return_inverse=True)
    written = pa.array([text(int(v)) for v in distinct], pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(place, pa.int32(), mask=~valid), written).cast(pa.string())


def _address(value: int) -> str:
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _mac(value: int) -> str:
    return ":".join(f"{value >> s & 255:02x}" for s in (40, 32, 24, 16, 8, 0))


class _Bytes:
    """Reads at many positions; positions outside the buffer read as 0 and are masked by the caller."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(64, np.uint8))
        self.last = len(self.data) - 1

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(size):
            out = out << 8 | self.data[np.minimum(at + i, self.last)]
        return out


def packet_columns(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, pa.Array]:
    """Columns of the frames at ``start`` with ``size`` bytes each."""
    raw, n = _Bytes(data), len(start)
    end = start + size
    at, kind = start + 14, raw.number(start + 12, 2)
    reason = np.full(n, "", object)
    reason[size < 14] = SHORT_FRAME
    while (tagged := (reason == "") & np.isin(kind, (0x8100, 0x88A8))).any():
        short = tagged & (at + 4 > end)
        reason[short] = SHORT_FRAME
        tagged &= ~short
        kind[tagged] = raw.number(at[tagged] + 2, 2)
        at[tagged] += 4
    arp = (reason == "") & (kind == 0x0806)
    ip = (reason == "") & (kind == 0x0800) & (at < end) & (raw.number(at, 1) >> 4 == 4)
    reason[(reason == "") & ~arp & ~ip] = NOT_IP
    reason[arp & (at + 28 > end)] = SHORT_ARP
    reason[ip & (at + 20 > end)] = SHORT_IP
    arp, ip = arp & (reason == ""), ip & (reason == "")

    head, total = (raw.number(at, 1) & 15) * 4, raw.number(at + 2, 2)
    number = raw.number(at + 9, 1)
    body = np.minimum(at + head, end)
    stop = np.maximum(np.where(total > 0, np.minimum(at + total, end), end), body)
    length = stop - body
    tcp, udp, icmp = (ip & (number == k) for k in (6, 17, 1))
    reason[(tcp & (length < 16)) | (udp & (length < 4)) | (icmp & (length < 1))] = SHORT_TRANSPORT
    ok = ip & (reason == "")
    tcp, udp, icmp = tcp & ok, udp & ok, icmp & ok
    ports = tcp | udp
    sport, dport = np.where(icmp, 0, raw.number(body, 2)), np.where(icmp, 0, raw.number(body + 2, 2))
    offset = (raw.number(body + 12, 1) >> 4) * 4
    own_head = np.select([tcp, udp, icmp], [offset, 8, 4], 0)
    payload = np.where(ok & (number != 6) & (number != 17) & (number != 1), 0, np.maximum(0, length - own_head))
    begin = body + own_head
    filled = tcp & (payload > 0)
    lead = raw.number(begin, 5)
    request = filled & (((payload >= 4) & (lead >> 8 == int.from_bytes(b"GET "))) | ((payload >= 5) & (lead == int.from_bytes(b"POST "))))
    hello = filled & ~request & (lead >> 32 == 0x16)
    asked = udp & ((sport == 53) | (dport == 53))

    def ints(values, valid, kind=pa.int32()):
        return pa.array(values, kind, mask=~valid)

    return {
        "src_ip": _texts(raw.number(at + 12, 4), ok, _address), "dst_ip": _texts(raw.number(at + 16, 4), ok, _address),
        "src_port": ints(sport, ports | icmp), "dst_port": ints(dport, ports | icmp),
        "protocol": _texts(number, ok, lambda v: _TRANSPORTS.get(v, str(v))), "payload_len": ints(payload, ok),
        "header_len": ints(offset, tcp), "tcp_flags": ints(raw.number(body + 13, 1), tcp), "win": ints(raw.number(body + 14, 2), tcp),
        "first_byte": ints(lead >> 32, filled), "is_request": pa.array(request, pa.bool_(), mask=~filled),
        "icmp_type": ints(raw.number(body, 1), icmp), "arp_op": ints(raw.number(at + 6, 2), arp),
        "sender_mac": _texts(raw.number(at + 8, 6), arp, _mac), "sender_ip": _texts(raw.number(at + 14, 4), arp, _address),
        "target_ip": _texts(raw.number(at + 24, 4), arp, _address),
        "skipped": pa.array(reason, pa.string(), mask=reason == ""),
        **_named(data, begin, stop, request, hello, asked),
    }


def _named(data, begin, stop, request, hello, asked) -> dict[str, pa.Array]:
    """Columns that only packets with a readable payload have."""
    from flowloom.sources import capture as C

    n, whole = len(begin), data.tobytes()
    names = {"http_host": pa.string(), "user_agent": pa.string(), "sni": pa.string(), "dns_qnames": pa.list_(pa.string()), "tls_version": pa.int32(),
             **{f"tls_{k}": pa.list_(pa.int32()) for k in ("ciphers", "extensions", "groups", "formats")}}
    held = {name: [None] * n for name in names}
    for chosen, parse in ((request, C.request_fields), (hello, C.hello_fields), (asked, lambda p: {"dns_qnames": C.questions(p) or None})):
        for i in np.flatnonzero(chosen):
            for name, value in parse(whole[begin[i]:stop[i]]).items():
                held[name][i] = value
    return {name: pa.array(held[name], kind) for name, kind in names.items()}
