"""Registry of payload decoders: a name, the columns it gives, and a function over payload bytes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DECODERS: dict[str, Callable[[bytes], dict | None]] = {}


def decoder(name: str) -> Callable[[Callable[[bytes], dict | None]], Callable[[bytes], dict | None]]:
    """Registers a function from payload bytes to a dict, or None where the payload is something else."""

    def add(f: Callable[[bytes], dict | None]) -> Callable[[bytes], dict | None]:
        DECODERS[name] = f
        return f

    return add


@decoder("http")
def _http(data: bytes) -> dict | None:
    line = data.split(b"\r\n", 1)[0].decode("latin-1").split(" ")
    if len(line) >= 3 and line[0].isupper() and line[-1].startswith("HTTP/"):
        return {"method": line[0], "target": " ".join(line[1:-1])}
    if len(line) >= 2 and line[0].startswith("HTTP/") and line[1].isdigit():
        return {"status": int(line[1])}
    return None


@decoder("ssh")
def _ssh(data: bytes) -> dict | None:
    return {"banner": data.split(b"\r\n", 1)[0].split(b"\n", 1)[0].decode("latin-1")} if data.startswith(b"SSH-") else None


@decoder("tls")
def _tls(data: bytes) -> dict | None:
    if len(data) < 6 or data[0] != 0x16 or data[1] != 3:
        return None
    return {"version": f"3.{data[2]}", "handshake": data[5]}


def _greeting(data: bytes) -> tuple[str, str]:
    """First word and rest of the first line of a text protocol."""
    line = data.split(b"\n", 1)[0].rstrip(b"\r").decode("latin-1")
    word, _, rest = line.partition(" ")
    return word, rest


#: First words of what clients of text protocols send.
COMMANDS = {
    "smtp": {"HELO", "EHLO", "MAIL", "RCPT", "STARTTLS"}, "ftp": {"USER", "PASS", "RETR", "STOR", "PASV", "EPSV", "CWD"}, "pop3": {"APOP", "STAT", "UIDL"},
    "sip": {"INVITE", "REGISTER", "BYE", "ACK", "CANCEL", "SUBSCRIBE", "NOTIFY"}, "rtsp": {"DESCRIBE", "SETUP", "PLAY", "TEARDOWN"},
}


@decoder("sip")
def _sip(data: bytes) -> dict | None:
    word, rest = _greeting(data)
    if word in COMMANDS["sip"] and rest.endswith("SIP/2.0"):
        return {"method": word, "target": rest.rsplit(" ", 1)[0]}
    return {"status": int(rest[:3])} if word == "SIP/2.0" and rest[:3].isdigit() else None


@decoder("rtsp")
def _rtsp(data: bytes) -> dict | None:
    word, rest = _greeting(data)
    return {"method": word, "target": rest.rsplit(" ", 1)[0]} if word in COMMANDS["rtsp"] and "RTSP/" in rest else None


@decoder("mail")
def _mail(data: bytes) -> dict | None:
    word, rest = _greeting(data)
    for name in ("smtp", "ftp", "pop3"):
        if word in COMMANDS[name]:
            return {"protocol": name, "command": word}
    return {"protocol": "reply", "code": int(word)} if len(word) == 3 and word.isdigit() and 100 <= int(word) < 600 and rest else None


@decoder("syslog")
def _syslog(data: bytes) -> dict | None:
    end = data.find(b">", 1, 6)
    if data[:1] != b"<" or end < 0 or not data[1:end].isdigit() or int(data[1:end]) > 191:
        return None
    facility, severity = divmod(int(data[1:end]), 8)
    return {"facility": facility, "severity": severity}


@decoder("ntp")
def _ntp(data: bytes) -> dict | None:
    if len(data) < 48 or data[0] >> 3 & 7 not in (1, 2, 3, 4) or not 1 <= data[0] & 7 <= 5:
        return None
    return {"version": data[0] >> 3 & 7, "mode": data[0] & 7, "stratum": data[1]}


@decoder("dhcp")
def _dhcp(data: bytes) -> dict | None:
    if len(data) < 240 or data[0] not in (1, 2) or data[236:240] != b"\x63\x82\x53\x63":
        return None
    return {"op": data[0], "mac": data[28:34].hex(":"), "address": ".".join(map(str, data[16:20]))}


@decoder("snmp")
def _snmp(data: bytes) -> dict | None:
    if len(data) < 9 or data[0] != 0x30:
        return None
    at = 2 if data[1] < 0x80 else 2 + (data[1] & 0x7F)
    if data[at : at + 2] != b"\x02\x01" or data[at + 2] > 3 or data[at + 3] != 4:
        return None
    return {"version": data[at + 2] + 1, "community": data[at + 5 : at + 5 + data[at + 4]].decode("latin-1")}


@decoder("tftp")
def _tftp(data: bytes) -> dict | None:
    if len(data) < 4 or data[0] or data[1] not in (1, 2):
        return None
    name, _, mode = data[2:].partition(b"\0")
    return {"op": data[1], "file": name.decode("latin-1")} if name and mode.split(b"\0")[0].lower() in (b"octet", b"netascii") else None


@decoder("smb")
def _smb(data: bytes) -> dict | None:
    return {"version": 1 if data[4:8] == b"\xffSMB" else 2} if data[4:8] in (b"\xffSMB", b"\xfeSMB") else None


@decoder("bgp")
def _bgp(data: bytes) -> dict | None:
    return {"type": data[18]} if len(data) >= 19 and data[:16] == b"\xff" * 16 and 1 <= data[18] <= 5 else None


@decoder("dns")
def _dns(data: bytes) -> dict | None:
    from ..sources.formats import decode_dns

    return decode_dns(data)


def decode(payload: str | Column, *names: str) -> Column:
    """JSON {"decoder": ..., fields} of the first named decoder (all, if none is named) that knows the payload, or null.

    Runs on Arrow batches; a decoder that fails counts as not knowing the payload.
    """
    chosen = {n: DECODERS[n] for n in names or DECODERS}

    def run(payloads: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            for name, f in chosen.items():
                try:
                    found = f(bytes(data)) if data else None
                except Exception:  # noqa: BLE001  what a plug-in throws is no reason to lose the row
                    found = None
                if found:
                    return json.dumps({"decoder": name, **found}, sort_keys=True, default=str)
            return None

        return payloads.map(one)

    return F.pandas_udf(run, "string")(payload)
