"""Models as canonical JSON with a digest, checked when they are read again."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict

from spotlake.operators.rules import FEATURES, Model


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(body: dict) -> str:
    """SHA-256 of the canonical JSON without the digest itself."""
    return hashlib.sha256(canonical({k: v for k, v in body.items() if k != "sha256"}).encode()).hexdigest()


def sealed(kind: str, content: dict) -> str:
    body = {"kind": kind, "version": 1, **content}
    return canonical({**body, "sha256": digest(body)})


def opened(text: str, kind: str) -> dict:
    body = json.loads(text)
    if not isinstance(body, dict) or body.get("kind") != kind or body.get("version") != 1:
        raise ValueError(f"not a {kind} of version 1")
    if body.get("sha256") != digest(body):
        raise ValueError("the digest does not match")
    return body


def candidate_model_json(model: Model) -> str:
    return sealed("candidate_model", asdict(model.checked()))


def candidate_model(text: str) -> Model:
    """The model of a text; another set of features, a wrong digest or unusable numbers raise."""
    body = opened(text, "candidate_model")
    if tuple(body["names"]) != tuple(FEATURES):
        raise ValueError("the model was made for other features")
    parts = {k: tuple(v) if isinstance(v, list) else v for k, v in body.items() if k not in ("kind", "version", "sha256")}
    return Model(**parts).checked()


def checked_forest(trees: list[list[tuple]], features: int = 17) -> list[list[tuple]]:
    """The forest, if every tree is one: children stand after their parent, each node but the root has one parent."""
    if not trees:
        raise ValueError("no trees")
    for nodes in trees:
        if not nodes:
            raise ValueError("an empty tree")
        seen = []
        for i, (feature, threshold, left, right, p, samples) in enumerate(nodes):
            if not (math.isfinite(threshold) and 0 <= p <= 1 and samples >= 0 and -1 <= feature < features):
                raise ValueError(f"node {i} is not usable")
            if feature >= 0:
                if not (i < left < len(nodes) and i < right < len(nodes)):
                    raise ValueError(f"node {i} has wrong children")
                seen += [left, right]
        if sorted(seen) != list(range(1, len(nodes))):
            raise ValueError("nodes are shared or unreachable")
    return trees


def forest_json(trees: list[list[tuple]], threshold: float = 0.5, features: int = 17) -> str:
    return sealed("pixel_model", {"features": features, "threshold": threshold, "trees": [[list(n) for n in t] for t in checked_forest(trees, features)]})


def forest(text: str) -> tuple[list[list[tuple]], float]:
    body = opened(text, "pixel_model")
    if not 0 < body["threshold"] < 1:
        raise ValueError("the threshold must lie in (0, 1)")
    return checked_forest([[tuple(n) for n in t] for t in body["trees"]], body["features"]), body["threshold"]
