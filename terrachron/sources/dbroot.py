"""The bootstrap record of a quadtree database: epoch and providers, by a small wire-format reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import inflate, unmask

IMAGERY, HISTORY = 0, 3


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """``(number, value)`` of a record's fields in order; groups come as the bytes between their marks."""
    out, at = [], 0

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    while at < len(data):
        key, at = varint(at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 3:
            depth, start = 1, at
            while depth:
                end = at
                k, at = varint(at)
                if k & 7 == 3:
                    depth += 1
                elif k & 7 == 4:
                    depth -= 1
                elif k & 7 == 0:
                    _, at = varint(at)
                elif k & 7 == 2:
                    n, at = varint(at)
                    at += n
                else:
                    at += 8 if k & 7 == 1 else 4
            value = data[start:end]
        else:
            raise ValueError(f"wire type {kind}")
        out.append((number, value))
    return out


#: Field numbers of the records that are used.
ENVELOPE = {"key": 2, "body": 3}
ROOT = {"provider": 3, "version": 13}
PROVIDER = {"id": 1, "copyright": 2}
TEXT = {"value": 2}
VERSION = {"quadtree": 1}
PACKET = {"epoch": 1, "node": 2}
NODE = {"index": 3, "node": 4}
QUADTREE = {"flags": 1, "cache_epoch": 2, "layer": 3}
LAYER = {"type": 1, "epoch": 2, "provider": 3, "dates": 4}
DATES = {"dated": 1}
DATED = {"date": 1, "epoch": 2, "provider": 3}


def _one(pairs, number: int, default=None):
    return next((v for n, v in pairs if n == number), default)


def read_root(envelope: bytes, numbers: dict = ROOT) -> dict:
    """``key, quadtree_version, providers`` of an enveloped, masked and deflated root record."""
    env = fields(envelope)
    key = _one(env, ENVELOPE["key"], b"")
    root = fields(inflate(unmask(_one(env, ENVELOPE["body"], b""), key)))
    version = fields(_one(root, numbers["version"], b""))
    providers = []
    for n, v in root:
        if n == numbers["provider"]:
            p = fields(v)
            text = fields(_one(p, PROVIDER["copyright"], b""))
            providers.append((_one(p, PROVIDER["id"], 0), _one(text, TEXT["value"], b"").decode("utf-8", "replace")))
    return {"key": key, "quadtree_version": _one(version, VERSION["quadtree"], 0), "providers": providers}


def read_packet(data: bytes) -> tuple[int, list[tuple]]:
    """``(epoch, nodes)`` of a record packet; a node is ``(number, cache epoch, imagery epoch or None, dates)``,
    a date ``(packed date, epoch, provider)``."""
    packet, nodes = fields(data), []
    for n, group in packet:
        if n != PACKET["node"]:
            continue
        pair = fields(group)
        node = fields(_one(pair, NODE["node"], b""))
        imagery, dates = None, []
        for k, raw in node:
            if k != QUADTREE["layer"]:
                continue
            layer = fields(raw)
            kind = _one(layer, LAYER["type"], 0)
            if kind == IMAGERY:
                imagery = _one(layer, LAYER["epoch"], 0)
            elif kind == HISTORY:
                for m, entry in fields(_one(layer, LAYER["dates"], b"")):
                    if m == DATES["dated"]:
                        e = fields(entry)
                        dates.append((_one(e, DATED["date"], 0), _one(e, DATED["epoch"], 0), _one(e, DATED["provider"], 0)))
        nodes.append((_one(pair, NODE["index"], 0), _one(node, QUADTREE["cache_epoch"], 0), imagery, dates))
    return _one(packet, PACKET["epoch"], 0), nodes


def provider_table(spark: SparkSession, root: dict) -> DataFrame:
    return spark.createDataFrame(root["providers"], "provider_id int, copyright string")
