"""Predicates on exchanges and facts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of user turns that tools put there, and the answers that acknowledge and say no more.
ARTIFACTS = ["<local-command-stdout>", "<local-command-caveat>", "<command-name>", "Caveat:"]
ACKNOWLEDGED = r"(?i)^(ok(ay)?|yes|no|y|n|thanks?|thank you|good|nice|great|done|go|proceed|continue|응|넵?|네|예|아니오?|ㅇㅇ|ㅇㅋ|ㄱㄱ|좋아요?|그래|고마워요?|감사(합니다|해요)?|해줘|진행해?줘?|계속(해줘)?)[.!~\s]*$"
# Beginnings of the prompts that background workers send to a model.
WORKER_LEADS = [
    "You are an expert at extracting long-term facts from conversations.",
    "You are an ontology classifier for technical decision facts.",
    "You are analyzing relationships between technical decision facts.",
    "Compare two facts and determine their relationship.",
]
# Fixed value: the first message of a helper agent that is only being started.
HANDSHAKE = "Warmup"
# Fixed value: titles of numbered standard documents.
NUMBERED_TITLE = r"^(0[1-9]|10)-[a-z0-9-]+ memory\b"


def starts_with_any(c: Column, leads: list[str]) -> Column:
    """False for null."""
    out = F.lit(False)
    for lead in leads:
        out = out | c.startswith(lead)
    return F.coalesce(out, F.lit(False))


def substantive(user: Column, assistant: Column) -> Column:
    """Whether an exchange says something: not empty, no tool artifact, no bare command, no acknowledgement with a short answer."""
    u, a = F.trim(F.coalesce(user, F.lit(""))), F.trim(F.coalesce(assistant, F.lit("")))
    return ~((u == "") | starts_with_any(u, ARTIFACTS) | u.rlike(r"^/[\w:-]+$") | (u.rlike(ACKNOWLEDGED) & (F.length(a) < 200)) | ((F.length(u) < 5) & (F.length(a) < 80)))


def pollution(project: Column, user: Column, sidechain: Column, suffix: str, leads: list[str] | None = None, handshake: bool = True) -> Column:
    """Whether an exchange is a machine's own: by its project's suffix, by a worker's prompt, or as a handshake, which is exact and of a sidechain."""
    out = F.coalesce(project.endswith(suffix), F.lit(False)) | starts_with_any(user, leads or [])
    if handshake:
        out = out | (F.coalesce(user == HANDSHAKE, F.lit(False)) & F.coalesce(sidechain, F.lit(False)))
    return out


def heritage(created: Column, fact: Column, sources: Column, cutoff: str | None, source_lead: str) -> Column:
    """Whether a fact is older than the cutoff day, or one of the numbered documents; without a cutoff none is."""
    if cutoff is None:
        return F.lit(False)
    day = F.substring(created, 1, 10)
    old = (F.length(day) == 10) & (day < cutoff)
    listed = F.exists(sources, lambda x: x.startswith(source_lead)) & fact.rlike(NUMBERED_TITLE)
    return F.coalesce(old, F.lit(False)) | F.coalesce(listed, F.lit(False))


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies in it; a root that is only a prefix of the name doesn't count."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        out = out | (path == root) | path.startswith(root + "/")
    return F.coalesce(out, F.lit(False))


def relevance(confirmed: Column, created: Column, in_project: Column, now: str) -> Column:
    """3 (1 + log2(n + 1)) for n confirmations (3 for none), plus 5, 3 or 1 within 7, 30 or 90 days, plus 2 in the project."""
    days = F.datediff(F.lit(now).cast("date"), F.substring(created, 1, 10).try_cast("date"))
    recent = F.when(days <= 7, 5).when(days <= 30, 3).when(days <= 90, 1).otherwise(0)
    base = F.when(confirmed > 0, 3 * (1 + F.log2(confirmed + 1))).otherwise(3.0)
    return base + recent + F.when(in_project, 2).otherwise(0)


# Words that a decision is told by.
DECISION_WORDS = ["decision", "decided", "chose", "选择", "결정", "선택", "approach", "strategy", "architecture", "pattern", "refactor"]


def names_any(*columns: str, words: list[str] = DECISION_WORDS) -> Column:
    """Whether any of the words stands anywhere in the columns, without letter case: a cheap look before anything reads the texts."""
    return F.concat_ws(" ", *columns).rlike("(?i)" + "|".join(f"\\Q{w}\\E" for w in words))
