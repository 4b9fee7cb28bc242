"""A feature service answered from memory: one paging layer, one with ids only, one without rows."""

import json
import re

ROWS = {0: 25, 1: 23, 2: 0}


def feature(layer, n):
    return {"attributes": {"OBJECTID": n, "LAYER": layer}, "geometry": {"x": float(n), "y": float(layer)}}


def fetch(url, params):
    tail = url.split("/FeatureServer")[1]
    if tail == "":
        return 200, json.dumps({"layers": [{"id": i, "name": f"layer {i}"} for i in ROWS]})
    layer = int(tail.split("/")[1])
    if not tail.endswith("/query"):
        return 200, json.dumps({"maxRecordCount": 10, "supportsPagination": layer == 0} if layer != 2 else {})
    if params.get("returnCountOnly"):
        return 200, json.dumps({"count": ROWS[layer]})
    if "outStatistics" in params:
        kinds = [x["statisticType"] for x in json.loads(params["outStatistics"])]
        ids = ROWS[layer] and {"min": 0, "max": ROWS[layer] - 1}
        return 200, json.dumps({"features": [{"attributes": {k: ids[k] if ids else None for k in kinds}}]})
    if "resultOffset" not in params:
        low, high = map(int, re.findall(r"OBJECTID (?:>=|<) (\d+)", params["where"]))
        wanted = range(low, min(high, ROWS[layer]))
    else:
        first = params["resultOffset"]
        wanted = range(first, min(first + params["resultRecordCount"], ROWS[layer]))
    return 200, json.dumps({"features": [feature(layer, n) for n in wanted]})


def fetch_only_layer_one(url, params):
    tail = url.split("/FeatureServer")[1]
    if tail.startswith(("/0", "/2")):
        raise AssertionError(f"layer {tail} was asked for")
    return fetch(url, params)


def fetch_broken(url, params):
    """Layer 0 does not count, layer 2 has no document; layer 1 answers."""
    tail = url.split("/FeatureServer")[1]
    if tail == "/2":
        return 500, "<html>down</html>"
    if tail == "/0/query" and params.get("returnCountOnly"):
        return 200, json.dumps({"error": {"code": 400, "message": "no counts"}})
    return fetch(url, params)


def fetch_growing(url, params):
    """Layer 0 counts rows of an hour ago: it has grown by two pages since."""
    if params.get("returnCountOnly"):
        return 200, json.dumps({"count": ROWS[0] - 20})
    return fetch(url, params)
