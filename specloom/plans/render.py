"""The contract as an OpenAPI 3.0 document, from the collected tables of one API.

The tables hold one row a field, parameter or response: their size is the contract's, not the log's.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from http import HTTPStatus

FORBIDDEN_UNDER_TYPES = {"string": {"minimum", "maximum", "properties", "items", "required"}, "integer": {"format", "enum", "properties", "items"}}
METHOD_ORDER = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE"]


def status_phrase(status: int | str) -> str:
    try:
        return HTTPStatus(int(status)).phrase
    except ValueError:
        return f"Status {status}"


def schema_of(rows: list[dict]) -> dict:
    """JSON Schema of one scope's field rows, as OpenAPI: null is `nullable`, several types are `anyOf`."""
    by_path = {r["path"]: r for r in rows}
    children: dict[str, list[str]] = {}
    for r in rows:
        if r["parent"] is not None:
            children.setdefault(r["parent"], []).append(r["path"])

    def build(path: str) -> dict:
        r = by_path[path]
        branches = []
        for kind in r["types"] or []:
            node: dict = {"type": kind}
            if kind == "object":
                props = sorted(p for p in children.get(path, []) if not p.endswith("[]"))
                node |= {"properties": {p.rsplit(".", 1)[-1]: build(p) for p in props}, "additionalProperties": False}
                if needed := [p.rsplit(".", 1)[-1] for p in props if by_path[p]["required"]]:
                    node["required"] = needed
            elif kind == "array":
                node["items"] = build(f"{path}[]") if f"{path}[]" in by_path else {}
            elif kind == "string":
                node |= {k: r[k] for k in ("format", "enum") if r.get(k)}
            elif kind == "integer":
                if r.get("lo") is not None:
                    node["x-observed-range"] = [r["lo"], r["hi"]]
                if r.get("minimum") is not None:
                    node["minimum"] = r["minimum"]
            branches.append(node)
        out = branches[0] if len(branches) == 1 else {"anyOf": branches} if branches else {}
        if r.get("nullable"):
            out["nullable"] = True
            out["x-null-rate"] = r["null_rate"]
            if out.get("enum"):
                out["enum"] = [*out["enum"], None]
        if path and not path.endswith("[]"):
            out["x-presence"] = r["presence_lb"]
        for name, key in (("x-confidence", "confidence"), ("x-aliases", "aliases"), ("x-enum-confidence", "enum_confidence")):
            if r.get(key):
                out[name] = r[key]
        if r.get("ambiguity"):
            out["x-ambiguity"] = r["ambiguity"][0] if len(r["ambiguity"]) == 1 else list(r["ambiguity"])
        if len(r["observed_types"] or []) > len(r["types"] or []):
            out["x-observed-types"] = list(r["observed_types"])
        return out

    return build("") if "" in by_path else {}


def param_schema(kind: str) -> dict:
    return {"type": "string", "format": "uuid"} if kind == "string/uuid" else {"type": kind}


def build_spec(endpoints: list[dict], fields: list[dict], path_params: list[dict], query_params: list[dict], inferred: list[dict] = (), examples: list[dict] = (), title: str = "Observed API") -> dict:
    key = lambda r: (r["method"], r["template"])
    scopes: dict[tuple, dict[str, list[dict]]] = {}
    for f in fields:
        scopes.setdefault(key(f), {}).setdefault(f["scope"], []).append(f)
    shown = {(*key(e), str(e["status"])): e["example"] for e in examples}
    spec: dict = {"openapi": "3.0.3", "info": {"title": title, "version": "1.0.0"}, "paths": {}}
    used: set[str] = set()
    secured = False
    for e in sorted(endpoints, key=lambda e: (e["template"], METHOD_ORDER.index(e["method"]) if e["method"] in METHOD_ORDER else 99)):
        own, parts = scopes.get(key(e), {}), [p for p in e["template"].split("/") if p]
        name = "_".join([e["method"].lower(), *(re.sub(r"\W", "_", f"by_{p[1:-1]}" if p.startswith("{") else p) for p in parts)]) if parts else f"{e['method'].lower()}_root"
        unique, k = name, 1
        while unique in used:
            k += 1
            unique = f"{name}_{k}"
        used.add(unique)
        op: dict = {"operationId": unique, "tags": [next((p for p in parts if not p.startswith("{")), "root")], "responses": {}, "x-sample-count": e["sample_count"]}
        op |= {x: e[c] for x, c in (("x-first-seen", "first_seen"), ("x-last-seen", "last_seen"), ("x-api-version", "api_version")) if e.get(c)}
        named = {p["name"]: p["type"] for p in path_params if key(p) == key(e)}
        params = [{"name": n, "in": "path", "required": True, "schema": param_schema(named.get(n, "string"))} for n in re.findall(r"{([^}]*)}", e["template"])]
        params += [{"name": p["name"], "in": "query", "required": p["required"], "schema": param_schema(p["type"])} for p in sorted(query_params, key=lambda p: p["first"]) if key(p) == key(e)]
        if params:
            op["parameters"] = params
        if "request" in own:
            op["requestBody"] = {"required": bool(e.get("request_required")), "content": {"application/json": {"schema": schema_of(own["request"])}}}
        for status in sorted({*map(str, e["statuses"])}):
            answer: dict = {"description": status_phrase(status)}
            if status in own:
                content: dict = {"schema": schema_of(own[status])}
                if (*key(e), status) in shown:
                    content["example"] = json.loads(shown[*key(e), status])
                answer["content"] = {"application/json": content}
            op["responses"][status] = answer
        for i in inferred:
            if key(i) == key(e) and str(i["status"]) not in op["responses"]:
                op["responses"][str(i["status"])] = {"description": status_phrase(i["status"]), "x-inferred": True, "x-evidence": i["evidence"], "x-confidence": i["confidence"]}
        op["responses"] = op["responses"] or {"default": {"description": "No response observed"}}
        if (e.get("auth_rate") or 0) >= 0.5:
            op["security"], secured = [{"bearerAuth": []}], True
        spec["paths"].setdefault(e["template"], {})[e["method"].lower()] = op
    if secured:
        spec["components"] = {"securitySchemes": {"bearerAuth": {"type": "http", "scheme": "bearer"}}}
    return spec


def mock_spec(spec: dict) -> dict:
    """The contract for mock servers: observed ranges become limits."""

    def walk(node):
        if isinstance(node, dict):
            out = {k: walk(v) for k, v in node.items()}
            if "x-observed-range" in out:
                out["minimum"], out["maximum"] = out.pop("x-observed-range")
            return out
        return [walk(x) for x in node] if isinstance(node, list) else node

    return walk(spec)


def validate_spec(spec: object) -> list[str]:
    """What is wrong with a document; nothing raises."""
    if not isinstance(spec, dict):
        return ["the document is no object"]
    found = [f"{k} is missing" for k in ("openapi", "info", "paths") if k not in spec]
    ids: set[str] = set()
    for path, item in (spec.get("paths") or {}).items() if isinstance(spec.get("paths"), dict) else []:
        if not str(path).startswith("/"):
            found.append(f"{path}: a path begins with /")
        for method, op in item.items() if isinstance(item, dict) else []:
            if not isinstance(op, dict) or not op.get("responses"):
                found.append(f"{method} {path}: no responses")
                continue
            if op.get("operationId") in ids:
                found.append(f"{method} {path}: operationId is used twice")
            ids.add(op.get("operationId"))
            declared = {p.get("name") for p in op.get("parameters", []) if p.get("in") == "path"}
            found += [f"{method} {path}: {n} is not declared" for n in re.findall(r"{([^}]*)}", str(path)) if n not in declared]
    return found


def write_text(path: str, text: str) -> None:
    """A file is whole or not there: written beside its place, synced and renamed."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_spec(spec: dict, path: str) -> list[str]:
    """path without its ending, as .json, .yaml and .mock.json; returns the files."""
    import yaml

    class Plain(yaml.SafeDumper):
        def ignore_aliases(self, data):
            return True

    base = re.sub(r"\.(json|ya?ml)$", "", path)
    files = {f"{base}.json": json.dumps(spec, indent=2, ensure_ascii=False), f"{base}.yaml": yaml.dump(spec, Dumper=Plain, sort_keys=False, allow_unicode=True), f"{base}.mock.json": json.dumps(mock_spec(spec), indent=2, ensure_ascii=False)}
    for name, text in files.items():
        write_text(name, text)
    return list(files)


def load_spec(path: str) -> dict | None:
    """A YAML or JSON document; None if it can't be read as one."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (OSError, ValueError, yaml.YAMLError):
        return None
    return found if isinstance(found, dict) else None
