"""Evidence, sources and truth classes as Column expressions, with the names of their kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by number, in order.
EVIDENCE_KINDS = ("fact", "inference", "uncertain", "unknown", "conflicted")
TRUTH_CLASSES = ("FACT", "INFERENCE", "UNCERTAIN", "UNKNOWN", "CONFLICTED")
SOURCE_KINDS = ("unknown", "web", "local_file", "database", "code")
NODE_KINDS = {1: "source", 2: "document", 3: "claim", 4: "person", 5: "organization", 6: "technology", 7: "code", 8: "system", 255: "unknown"}
EDGE_KINDS = {1: "supports", 2: "contradicts", 3: "relates", 4: "derived_from", 5: "implemented_by", 6: "depends_on"}
SEGMENT_KINDS = {1: "text", 2: "code", 3: "latex"}
DECISIONS = {0: "ALLOW", 1: "BLOCKED_ROBOTS", 2: "INVALID_URL", 3: "FRONTIER_FULL", 4: "DUPLICATE"}


def named(number: Column, names, default: str) -> Column:
    """The name of a number, or the default."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    table = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit(default))


def evidence_kind_name(kind: Column) -> Column:
    return named(kind, EVIDENCE_KINDS, "unknown")


def truth_class_name(truth: Column) -> Column:
    return named(truth, TRUTH_CLASSES, "UNKNOWN")


def present(x: Column) -> Column:
    return F.coalesce(F.length(x) > 0, F.lit(False))


def evidence_valid(kind: Column, source: Column, claim: Column) -> Column:
    """A claim is there, facts name a source, and the kind is known."""
    return present(claim) & ((kind != 0) | present(source)) & F.coalesce(kind.between(0, len(EVIDENCE_KINDS) - 1), F.lit(False))


def source_usable(kind: Column, uri: Column, content_hash: Column, verified: Column) -> Column:
    """A verified source of known kind with a URI; a content hash, where given, is not all zeros (32 bytes)."""
    hash_ok = content_hash.isNull() | (content_hash != F.unhex(F.lit("00" * 32)))
    return present(uri) & F.coalesce(kind != 0, F.lit(False)) & F.coalesce(verified, F.lit(False)) & hash_ok


def source_reject_code(kind: Column, uri: Column, content_hash: Column, verified: Column) -> Column:
    """0 none, 1 no URI or unknown kind, 2 unverified, 3 no hash. An empty URI and a hash of zeros count as given here."""
    return F.when(uri.isNull() | F.coalesce(kind == 0, F.lit(True)), 1).when(~F.coalesce(verified, F.lit(False)), 2).when(content_hash.isNull(), 3).otherwise(0)


def truth_class(sources: Column, conflicts: Column) -> Column:
    """From the numbers of supporting and conflicting sources."""
    return (
        F.when(sources.isNull() | (sources == 0), "UNKNOWN")
        .when(conflicts >= F.greatest(sources, F.lit(1)), "CONFLICTED")
        .when(conflicts > 0, "UNCERTAIN")
        .when(sources >= 2, "FACT")
        .otherwise("INFERENCE")
    )


def single_source(sources: Column) -> Column:
    return F.coalesce(sources <= 1, F.lit(True)).cast("int")


def checked_add(a: Column, b: Column) -> Column:
    """The sum, null on overflow."""
    return F.try_add(a, b)


def checked_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def model_floats(vocab: Column, embed: Column, layers: Column, kv: Column, ffn: Column) -> Column:
    """Parameters of a decoder: embeddings twice, a last norm, and per layer two square maps, three of the feed-forward, two of keys and values, two norms. Null for sizes of zero and on overflow."""
    v, e, n, k, f = (x.cast("bigint") for x in (vocab, embed, layers, kv, ffn))
    twice = F.lit(2).cast("bigint")
    square, feed, keys = F.try_multiply(e, e), F.try_multiply(f, e), F.try_multiply(k, e)
    layer = F.try_add(F.try_add(F.try_multiply(twice, square), F.try_multiply(F.lit(3).cast("bigint"), feed)), F.try_add(F.try_multiply(twice, keys), F.try_multiply(twice, e)))
    total = F.try_add(F.try_add(F.try_multiply(layer, n), F.try_multiply(twice, F.try_multiply(v, e))), e)
    return F.when((v > 0) & (e > 0) & (n > 0) & (k > 0) & (f > 0), total)
