"""Controlled vocabularies: spellings to canonical tokens; unknown values are kept, never defaulted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.columns import as_col, lookup, vocab_key

# Accepted spellings of each canonical token, compared in small letters after trimming.
SEVERITY = {
    "CRITICAL": ["critical", "crit", "sev1", "sev-1", "sev 1", "p1", "s1"],
    "HIGH": ["high", "sev2", "sev-2", "sev 2", "p2", "s2"],
    "MEDIUM": ["medium", "med", "moderate", "sev3", "sev-3", "sev 3", "p3", "s3"],
    "LOW": ["low", "sev4", "sev-4", "sev 4", "p4", "s4", "info", "informational"],
}
ESCALATION = {
    "ESCALATED": ["escalated", "yes", "y", "true", "escalate"],
    "NOT_ESCALATED": ["not_escalated", "not escalated", "no", "n", "false", "none"],
    "PENDING": ["pending", "requested"],
}
DISPOSITION = {
    "CLOSED": ["closed", "resolved", "fixed", "completed", "done"],
    "FALSE_POSITIVE": ["false_positive", "false positive", "fp", "benign"],
    "DUPLICATE": ["duplicate", "dup"],
    "WONT_FIX": ["wont_fix", "won't fix", "wont fix", "deferred"],
    "OPEN": ["open", "reopened", "re-opened", "in_progress", "in progress"],
}
VOCABULARIES = {"severity": SEVERITY, "escalation": ESCALATION, "disposition": DISPOSITION}


def canonical(c: Column | str, vocabulary: str) -> Column:
    """Canonical token or NULL when absent or unknown; a boolean is no word of any vocabulary.

    `none` stands in the escalation table but counts as absent first, so it stays unknown.
    """
    pairs = {s: k for k, spellings in VOCABULARIES[vocabulary].items() for s in spellings}
    return F.when(F.typeof(as_col(c)) != "boolean", lookup(vocab_key(as_col(c).cast("string")), pairs))


def normalised(c: Column | str, vocabulary: str) -> Column:
    """struct(canonical, original, known)."""
    k = canonical(c, vocabulary)
    return F.struct(k.alias("canonical"), as_col(c).alias("original"), k.isNotNull().alias("known"))


def record(df: DataFrame, severity: str | None = None, escalation: str | None = None, disposition: str | None = None) -> DataFrame:
    """Adds `<vocabulary>_canonical` and `<vocabulary>_known` for the columns named; originals stay as submitted."""
    for vocabulary, column in (("severity", severity), ("escalation", escalation), ("disposition", disposition)):
        if column:
            k = canonical(column, vocabulary)
            df = df.withColumns({f"{vocabulary}_canonical": k, f"{vocabulary}_known": k.isNotNull()})
    return df
