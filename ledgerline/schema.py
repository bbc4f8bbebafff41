"""Tables of the claim graph and their closed vocabularies."""

from __future__ import annotations

#: The vocabularies.
CLAIM_STATUS = ("staged", "active", "rejected")
EDGE_LABELS = ("mentions", "contradicts", "supports", "derived_from", "possible_duplicate_of")
HEDGES = ("may", "might", "could", "possibly", "appears", "seems", "signals", "estimates", "reportedly", "tentative", "uncertain")
NEGATIONS = ("not", "no", "never")
DENIED_SECTIONS = ("section-kind:praise", "section-kind:copyright", "section-kind:acknowledgments")
REJECTIONS = ("missing_id", "missing_text", "missing_metadata", "conflict", "duplicate", "deleted_id")
EVIDENCE_STATES = ("resolved", "unresolvable", "tombstoned")
SHAPES = ("interrogative_final", "heading_fragment", "nav_boilerplate")

EPISODES = "id string, text string, locator struct<kind:string,value:string>, source_type string, data_cutoff string, authority_tier smallint, tags array<string>"
CLAIMS = "claim_key bigint, text string, valid_at string, invalid_at string, data_cutoff string, status string, scope string, source_type string, evidence struct<kind:string,text:string,locator:string>"
LINEAGE = "seq bigint, claim_key bigint, episode_id string, extractor_version string"
TABLES = {
    "episodes": EPISODES,
    "claims": CLAIMS,
    "lineage": LINEAGE,
    "extracted": "episode_id string, extractor_version string",
    "edges": "seq bigint, from_claim bigint, label string, to_claim bigint, provenance string",
    "audits": "seq bigint, claim_key bigint, actor string, adopted_at bigint",
    "restages": "seq bigint, claim_key bigint, actor string, restaged_at bigint",
    "supersessions": "seq bigint, claim_key bigint, reason string, superseded_at bigint",
    "invalidations": "seq bigint, claim_key bigint, causing_episode_id string",
    "reviews": "seq bigint, from_claim bigint, to_claim bigint, status string, evidence string, fingerprint string, queued_at bigint, resolved_at bigint, actor string, decision string",
    "review_audits": "seq bigint, from_claim bigint, to_claim bigint, decision string, actor string, resolved_at bigint",
    "contradiction_proposals": "seq bigint, from_claim bigint, to_claim bigint, status string, producer string, rationale string, fingerprint string, queued_at bigint, resolved_at bigint, actor string, decision string",
    "er_aliases": "a string, b string",
    "episode_tombstones": "episode_id string, deleted_at bigint",
    "evidence_refs": "claim_key bigint, episode_id string, locator_scheme_version string, observed_tier smallint",
    "evidence_checks": "check_id bigint, claim_key bigint, resolution_state string, checked_at bigint",
    "coverage_declarations": "run_id string, declared_count bigint, created_at_days bigint",
    "coverage_declared_ids": "run_id string, stable_id string",
}
