"""A small argument graph with known answers, and a document with all optional fields."""

from __future__ import annotations

from decimal import Decimal

# Id, kind, category, prior.
NODES = [
    ("R1", "root", None, "0.20"),
    ("C1", "claim", "observation", "0.55"),
    ("C2", "claim", "physical-intuition", "0.50"),
    ("C3", "claim", "visual-observation", "0.45"),
    ("C4", "claim", "distance-claims", "0.48"),
    ("C5", "claim", "meta-claim", "0.30"),
    ("P1", "premise", "observation", "0.68"),
    ("P2", "premise", "observation", "0.64"),
    ("P3", "premise", "visual-observation", "0.60"),
    ("P4", "premise", "visual-observation", "0.58"),
    ("P5", "premise", "distance-claims", "0.62"),
    ("P6", "premise", "measurement", "0.57"),
    ("E1", "evidence", None, "0.52"),
    ("E2", "evidence", None, "0.50"),
    ("E3", "evidence", None, "0.46"),
    ("E4", "evidence", None, "0.47"),
    ("E5", "evidence", None, "0.49"),
    ("E6", "evidence", None, "0.44"),
    ("O1", "counter", "visual-limit", "0.82"),
    ("O2", "counter", "optics", "0.84"),
    ("O3", "counter", "geometry", "0.86"),
    ("O4", "counter", "imaging", "0.72"),
    ("O5", "counter", "methodology", "0.77"),
    ("O6", "counter", "geometry", "0.81"),
    ("O7", "counter", "methodology", "0.79"),
    ("O8", "counter", "meta-claim", "0.74"),
    ("O9", "counter", "cross-cutting", "0.76"),
]

# Id, from, to, kind, weight.
EDGES = [
    ("E-R-C1", "C1", "R1", "support", "0.23"),
    ("E-R-C2", "C2", "R1", "support", "0.21"),
    ("E-R-C3", "C3", "R1", "support", "0.18"),
    ("E-R-C4", "C4", "R1", "support", "0.23"),
    ("E-R-C5", "C5", "R1", "support", "0.15"),
    ("E-C1-P1", "P1", "C1", "support", "0.60"),
    ("E-C1-E1", "E1", "C1", "support", "0.40"),
    ("E-C2-P2", "P2", "C2", "support", "0.55"),
    ("E-C2-E2", "E2", "C2", "support", "0.45"),
    ("E-C3-P3", "P3", "C3", "support", "0.50"),
    ("E-C3-P4", "P4", "C3", "support", "0.25"),
    ("E-C3-E3", "E3", "C3", "support", "0.15"),
    ("E-C3-E4", "E4", "C3", "support", "0.10"),
    ("E-C4-P5", "P5", "C4", "support", "0.55"),
    ("E-C4-P6", "P6", "C4", "support", "0.20"),
    ("E-C4-E5", "E5", "C4", "support", "0.15"),
    ("E-C4-E6", "E6", "C4", "support", "0.10"),
    ("E-C5-O8", "O8", "C5", "rebut", "0.80"),
    ("E-O1-P1", "O1", "P1", "rebut", "0.75"),
    ("E-O1-C1", "O1", "C1", "rebut", "0.25"),
    ("E-O2-P5", "O2", "P5", "rebut", "0.65"),
    ("E-O2-P6", "O2", "P6", "rebut", "0.35"),
    ("E-O3-P2", "O3", "P2", "rebut", "0.80"),
    ("E-O4-E3", "O4", "E3", "rebut", "0.55"),
    ("E-O4-E4", "O4", "E4", "rebut", "0.45"),
    ("E-O5-P4", "O5", "P4", "rebut", "0.45"),
    ("E-O5-E4", "O5", "E4", "rebut", "0.55"),
    ("E-O6-P5", "O6", "P5", "rebut", "0.70"),
    ("E-O6-C4", "O6", "C4", "rebut", "0.30"),
    ("E-O7-P6", "O7", "P6", "rebut", "0.55"),
    ("E-O7-E6", "O7", "E6", "rebut", "0.45"),
    ("E-O9-C1", "O9", "C1", "rebut", "0.34"),
    ("E-O9-C3", "O9", "C3", "rebut", "0.33"),
    ("E-O9-C4", "O9", "C4", "rebut", "0.33"),
]

EVIDENCE = {
    "E1": ("observational", 0.52, "Easy to gather."),
    "E2": ("observational", 0.5, None),
    "E3": ("video", 0.46, None),
    "E4": ("video", 0.47, None),
    "E5": ("observational", 0.49, None),
    "E6": ("experimental", 0.44, None),
}

LAYERS = {
    0: ["R1"],
    1: ["C1", "C2", "C3", "C4", "C5"],
    2: ["E1", "E2", "E3", "E4", "E5", "E6", "O8", "O9", "P1", "P2", "P3", "P4", "P5", "P6"],
    3: ["O1", "O2", "O3", "O4", "O5", "O6", "O7"],
}


def tables() -> dict[str, list[dict]]:
    nodes = [
        {
            "id": id,
            "graph_id": 1,
            "kind": kind,
            "title": f"Statement {id}",
            "body_text": f"Body of {id}.",
            "category": category,
            "tags": ["topic", "root"] if kind == "root" else [],
            "prior": Decimal(prior),
            "evidence": EVIDENCE.get(id),
        }
        for id, kind, category, prior in NODES
    ]
    edges = [
        {
            "id": id,
            "graph_id": 1,
            "from_node_id": source,
            "to_node_id": target,
            "kind": kind,
            "weight": Decimal(weight),
            "polarity": 1 if kind == "support" else -1,
            "rationale": "Challenges a branch." if id == "E-C5-O8" else None,
        }
        for id, source, target, kind, weight in EDGES
    ]
    graph = {"id": 1, "slug": "sample-medium", "title": "Sample", "description": "A seed graph."}
    return {"graphs": [graph], "nodes": nodes, "edges": edges}


LONG_TITLE = "No obvious curvature from high-altitude passenger footage"
SHORT_TITLE = "No obvious curvature from high..."

DOCUMENT = {
    "slug": "sample-medium",
    "title": "Sample document",
    "description": "Nodes are not in id order.",
    "nodes": [
        {"id": "R1", "kind": "root", "title": "Top", "bodyText": "Top.", "tags": ["topic", "root"], "prior": 0.2,
         "importance": 1},
        {"id": "C1", "kind": "claim", "title": "Claim", "bodyText": "Claim.", "category": "observation",
         "tags": ["visual"], "prior": 0.55, "importance": 0.74},
        {"id": "C3", "kind": "claim", "title": LONG_TITLE, "bodyText": "Pictures.", "category": "visual-observation",
         "prior": 0.45, "importance": 0.68},
        {"id": "P2", "kind": "premise", "title": "Premise", "bodyText": "Premise.", "prior": 0.64,
         "confidence": 0.58},
        {"id": "E1", "kind": "evidence", "title": "Photographs", "bodyText": "Photographs.", "tags": ["observational"],
         "prior": 0.52, "evidence": {"type": "observational", "score": 0.52, "rationale": "Easy to gather."}},
        {"id": "O2", "kind": "counter", "title": "Counter", "bodyText": "Counter.", "category": "optics",
         "prior": 0.84, "confidence": 0.8},
    ],
    "edges": [
        {"id": "E-R-C1", "from": "C1", "to": "R1", "kind": "support", "weight": 0.23},
        {"id": "E-R-C3", "from": "C3", "to": "R1", "kind": "support", "weight": 0.18},
        {"id": "E-C1-P2", "from": "P2", "to": "C1", "kind": "support", "weight": 0.6},
        {"id": "E-C1-E1", "from": "E1", "to": "C1", "kind": "support", "weight": 0.4},
        {"id": "E-O2-C3", "from": "O2", "to": "C3", "kind": "rebut", "weight": 0.7, "rationale": "Refraction."},
    ],
}
