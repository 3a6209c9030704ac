"""Which column carries which concept: scored candidates, decisions with explicit uncertainty, collisions, overrides.

Works on profile rows (one per column), so it runs on the driver whatever the table;
the plan of everything after depends on its outcome.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace

from auditlake.operators.concepts import PATHS

MAPPED, LOW_CONFIDENCE, AMBIGUOUS, UNMAPPED, INVALID = "MAPPED", "LOW_CONFIDENCE", "AMBIGUOUS", "UNMAPPED", "INVALID"
LEAST, SURE, MARGIN = 0.45, 0.60, 0.10


@dataclass(frozen=True)
class Pattern:
    concept: str
    path: str | None
    keywords: tuple[str, ...]
    negative: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    kind: str = "text"


# What names and values each concept has; where it goes is in the concept table.
PATTERNS = [
    Pattern(c, PATHS[c], *rest)
    for c, *rest in [
        ("ALERT_ID", ("alert_id", "alert"), ("time", "name", "level", "urgency", "severity", "case"), ("identifier",), (r"^[A-Z]{2,5}-\d+",), "identifier"),
        ("SECURITY_SEVERITY", ("severity", "priority", "urgency", "risk_rating", "alert_level"), (), ("categorical",), (r"(?i)^(critical|high|medium|low)$",), "categorical"),
        ("ASSET_IDENTIFIER", ("host", "asset", "hostname", "server", "system"), ("criticality", "type", "security", "source"), ("identifier",), (r"^[A-Z]{2,5}-\d+$",), "identifier"),
        ("ASSET_CRITICALITY", ("criticality", "business_impact"), (), ("categorical",), (r"(?i)^(critical|high|medium|low)$",), "categorical"),
        ("ESCALATION_STATUS", ("escalation_status", "escalated", "referral"), (), ("categorical",), (r"(?i)escalated",), "categorical"),
        ("THREAT_CATEGORY", ("threat", "attack", "category"), (), ("categorical",), (), "categorical"),
        ("INVESTIGATION_EVIDENCE", ("notes", "findings", "remarks", "investigation"), ("time",), (), (r"\w+ \w+ \w+ \w+",), "text"),
        ("EVENT_TIMESTAMP", ("created", "timestamp", "triggered", "raised", "_ts"), ("closed", "_by", "load"), (), (r"^\d{4}-\d\d-\d\d", r"^\d\d/\d\d/\d{4}"), "timestamp"),
        ("RESOLUTION_TIME", ("closed_time", "close_time", "resolution", "duration"), ("_by",), (), (r"^\d+$",), "timestamp"),
        ("USER_IDENTIFIER", ("_by", "user", "actor"), (), (), (r"^[a-z]+\.[a-z]$",), "identifier"),
        ("EXPECTED_TELEMETRY", ("telemetry", "monitoring"), (), (), (r"(?i)^(true|false|yes|no)$",), "categorical"),
        ("SECURITY_LABEL", ("label", "classification"), (), ("categorical",), (), "categorical"),
        ("EVENT_ID", ("event_id",), ("case",), ("identifier",), (r"^EV-\d+",), "identifier"),
        ("ALERT_NAME", ("alert_name",), (), ("categorical",), (), "categorical"),
        ("SOURCE_SYSTEM", ("source_system",), (), ("categorical",), (), "categorical"),
        ("CASE_ID", ("case_id", "case_number"), (), ("identifier",), (r"^CASE-\d+",), "identifier"),
        ("CASE_ALERT_ID", ("case_alert",), (), ("identifier",), (), "identifier"),
        ("ACKNOWLEDGED_AT", ("acknowledged", "ack_time"), (), (), (r"^\d{4}-\d\d-\d\d",), "timestamp"),
        ("CLOSED_AT", ("closed_at",), ("_by",), (), (r"^\d{4}-\d\d-\d\d",), "timestamp"),
        ("ANALYST_ID", ("analyst_id",), (), ("identifier",), (r"^ANL-\d+",), "identifier"),
        ("ESCALATION_LEVEL", ("escalation_level", "tier"), (), ("categorical",), (r"^L\d$",), "categorical"),
        ("CLOSURE_DISPOSITION", ("disposition",), (), ("categorical",), (), "categorical"),
        ("WORKFLOW_CASE_ID", ("event_case",), (), ("identifier",), (), "identifier"),
        ("WORKFLOW_EVENT_AT", ("event_at",), (), (), (r"^\d{4}-\d\d-\d\d",), "timestamp"),
        ("WORKFLOW_EVENT_TYPE", ("event_type",), (), ("categorical",), (), "categorical"),
        ("ASSET_TYPE", ("asset_type",), (), ("categorical",), (), "categorical"),
        ("NETWORK_ZONE", ("network_zone", "zone"), (), ("categorical",), (), "categorical"),
    ]
]
ROLES = {  # fixed values: anchor concept and supporting concepts of each dataset role, ties in this order
    "WORKFLOW": ("WORKFLOW_CASE_ID", ("WORKFLOW_EVENT_TYPE", "WORKFLOW_EVENT_AT", "WORKFLOW_ACTOR")),
    "CASES": ("CASE_ID", ("CASE_ALERT_ID", "ACKNOWLEDGED_AT", "CLOSED_AT", "CLOSURE_DISPOSITION")),
    "ALERTS": ("ALERT_ID", ("SECURITY_SEVERITY", "THREAT_CATEGORY", "EVENT_TIMESTAMP")),
    "ASSETS": ("ASSET_IDENTIFIER", ("ASSET_CRITICALITY", "EXPECTED_TELEMETRY")),
}


@dataclass(frozen=True)
class Decision:
    column: str
    concept: str | None
    path: str | None
    confidence: float
    state: str
    reason: str
    candidates: tuple[tuple[str, float], ...] = field(default=())
    collided: bool = False

    @property
    def applied(self) -> bool:
        return self.state in (MAPPED, LOW_CONFIDENCE)


def score(name: str, category: str, samples: list[str], p: Pattern) -> float:
    """Name hits, negative hits, category and value patterns, clamped to 0..1."""
    low = name.lower()
    hits = sum(k in low for k in p.keywords)
    total = min(0.5 + 0.1 * (hits - 1), 0.7) if hits else 0.0
    total -= min(0.25 * sum(k in low for k in p.negative), 0.5)
    total += 0.25 * (category in p.categories)
    total += 0.25 * sum(any(re.search(v, s) for s in samples) for v in p.values)
    return max(0.0, min(1.0, total))


def guarded(p: Pattern, column: str) -> str | None:
    """Reason why a column cannot carry a concept, or None."""
    low = column.lower()
    if low.endswith("_by") and p.kind == "timestamp":
        return "names an actor, not a time"
    if p.concept == "RESOLUTION_TIME" and any(x in low for x in ("closed_by", "created", "opened")):
        return "is not a resolution time"
    return None


def candidates(row: dict, patterns: list[Pattern] = PATTERNS) -> list[tuple[Pattern, float]]:
    """Concepts at or above the least confidence, best first, earlier pattern first on ties."""
    scored = [(p, round(score(row["column_name"], row["category"], row["samples"], p), 2)) for p in patterns]
    return sorted([x for x in scored if x[1] >= LEAST], key=lambda x: -x[1])


def decide(rows: list[dict], patterns: list[Pattern] = PATTERNS) -> list[Decision]:
    """One decision per column, collisions resolved."""
    out = []
    for row in rows:
        name, cs = row["column_name"], candidates(row, patterns)
        listed = tuple((p.concept, s) for p, s in cs)
        if not cs:
            out.append(Decision(name, None, None, 0.0, UNMAPPED, "no concept reaches the least confidence", listed))
            continue
        best, conf = cs[0]
        if why := guarded(best, name):
            out.append(Decision(name, best.concept, best.path, conf, INVALID, why, listed))
        elif best.path is None:
            out.append(Decision(name, best.concept, None, conf, INVALID, "the concept has no place", listed))
        else:
            rival = next((s for p, s in cs[1:] if p.path != best.path), None)
            state = AMBIGUOUS if rival is not None and conf - rival < MARGIN else MAPPED if conf >= SURE else LOW_CONFIDENCE
            out.append(Decision(name, best.concept, best.path, conf, state, {AMBIGUOUS: "another concept is as likely", MAPPED: "clear", LOW_CONFIDENCE: "likely"}[state], listed))
    return collide(out)


def collide(decisions: list[Decision]) -> list[Decision]:
    """Of several applied columns on one path the most confident stays (then by name); the others become ambiguous."""
    by = defaultdict(list)
    for d in decisions:
        if d.applied:
            by[d.path].append(d)
    lost = {d.column for ds in by.values() for d in sorted(ds, key=lambda d: (-d.confidence, d.column))[1:]}
    return [replace(d, state=AMBIGUOUS, reason="another column holds this place", collided=True) if d.column in lost else d for d in decisions]


def override(decisions: list[Decision], wanted: dict[str, str], patterns: list[Pattern] = PATTERNS) -> tuple[list[Decision], dict[str, str]]:
    """Reviewer's choices applied with the same guards; second value: rejected columns with reasons."""
    known = {p.concept: p for p in patterns}
    rejected, out = {}, {d.column: d for d in decisions}
    for column, concept in wanted.items():
        p = known.get(concept)
        if column not in out:
            rejected[column] = "no such column"
        elif p is None:
            rejected[column] = "no such concept"
        elif why := guarded(p, column):
            rejected[column] = why
        elif any(d.applied and d.path == p.path and d.column != column and d.column not in wanted for d in out.values()):
            rejected[column] = "another column holds this place"
        else:
            out[column] = Decision(column, concept, p.path, 1.0, MAPPED, "chosen by a reviewer")
    return collide(list(out.values())), rejected


def id_field(decisions: list[Decision], *concepts: str) -> str | None:
    """The first applied column of the concepts, in the order the concepts are named."""
    return next((d.column for c in concepts for d in decisions if d.applied and d.concept == c), None)


def ranked_options(row: dict, patterns: list[Pattern] = PATTERNS, limit: int = 8) -> list[tuple[str, float]]:
    """Concepts a reviewer may choose for a column: its candidates, then those that share name tokens with it, at most `limit` of these."""
    listed = [(p.concept, s) for p, s in candidates(row, patterns)]
    own = set(re.findall("[a-z0-9]+", row["column_name"].lower()))
    shared = [(p.concept, len(own & set(re.findall("[a-z0-9]+", " ".join((p.concept, *p.keywords)).lower())))) for p in patterns if p.concept not in {c for c, _ in listed}]
    fallback = sorted([x for x in shared if x[1]], key=lambda x: (-x[1], x[0]))[:limit]
    return listed + [(c, 0.0) for c, _ in fallback]


def role(decisions: list[Decision]) -> tuple[str, float]:
    """Dataset role and score from the applied concepts."""
    have = {d.concept for d in decisions if d.applied}
    best = ("UNKNOWN", 0.0)
    for name, (anchor, support) in ROLES.items():
        n = len(have & set(support))
        if anchor in have and n and (s := round((1 + n) / (1 + len(support)), 2)) > best[1]:
            best = (name, s)
    return best


def report(decisions: list[Decision]) -> dict:
    """Counts by confidence and coverage in percent."""
    done = [d for d in decisions if d.applied]
    return {
        "columns": len(decisions), "mapped": len(done), "unmapped": [d.column for d in decisions if not d.applied],
        "high": sum(d.confidence >= 0.85 for d in done), "medium": sum(0.5 <= d.confidence < 0.85 for d in done), "low": sum(d.confidence < 0.5 for d in done),
        "coverage_percent": round(100 * len(done) / len(decisions), 2) if decisions else 0.0,
    }


def project(df, decisions: list[Decision]):
    """Adds nothing, renames: applied columns by concept."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(d.column).alias(d.concept) for d in decisions if d.applied])


def canonical(df, decisions: list[Decision], keep: tuple[str, ...] = ()):
    """Applied columns of sufficient confidence as nested sections, beside the columns to keep.

    Values no record may carry become NULL; a section's notes set its availability flag.
    """
    from pyspark.sql import functions as F

    from auditlake.columns import is_mappable

    sections = defaultdict(list)
    for d in decisions:
        if d.applied and d.confidence >= LEAST:
            section, leaf = d.path.split(".")
            value = F.when(is_mappable(d.column), F.col(d.column))
            sections[section].append(value.alias(leaf))
            if leaf == "notes":
                sections[section].append(value.isNotNull().alias("available"))
    return df.select(*keep, *[F.struct(*cols).alias(s) for s, cols in sorted(sections.items())])
