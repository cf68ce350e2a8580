"""Scalar expressions over flow records: normalisation, surrogate entities, decisions and renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders and mappings that results depend on.
ACTIONS = ["PASS", "LOG", "MIRROR", "RATE_LIMIT", "REDIRECT", "DROP", "QUARANTINE"]
ENFORCING = ["DROP", "QUARANTINE", "RATE_LIMIT", "REDIRECT"]
DROPPING = ["DROP", "QUARANTINE"]
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
CEF_SEVERITY = {"low": 3, "medium": 6, "high": 8, "critical": 10}
MEMBER_RANK = {"ALIVE": 0, "SUSPECT": 1, "LEFT": 2, "DEAD": 3}
PROTOCOLS = {"6": "TCP", "17": "UDP", "1": "ICMP"}
FEATURES = ["pkt_len", "iat", "syn_ratio", "dst_fanout", "port_entropy", "byte_asymmetry", "pps"]
HEAD_WEIGHTS = {"dst_fanout": 2.6, "syn_ratio": 2.2, "pps": 2.0, "port_entropy": 1.4, "byte_asymmetry": 1.8}
HEAD_BIAS = -1.2
ATTRIBUTION_WEIGHTS = {"pkt_len": 0.4, "iat": -0.6, "syn_ratio": 2.2, "dst_fanout": 2.6, "port_entropy": 1.4, "byte_asymmetry": 1.8, "pps": 2.0}
MISSING = ["", "nan", "na", "null", "none"]
INFINITE = ["inf", "-inf", "infinity", "-infinity"]
MITIGATIONS = {
    "PASS": "none",
    "LOG": "record only",
    "MIRROR": "copy to observation port",
    "RATE_LIMIT": "token bucket on the flow",
    "REDIRECT": "route to decoy",
    "DROP": "discard packets of the flow",
    "QUARANTINE": "isolate the source",
}


def case(value: Column, mapping: dict, otherwise: Column | None = None) -> Column:
    """value looked up in a small literal mapping."""
    out = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out if otherwise is None else out.otherwise(otherwise)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normal_label(label: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "_-", "  ")


def is_benign(label: Column) -> Column:
    """Whether a data set's label names benign traffic, whatever its spelling."""
    x = normal_label(label)
    return x.isin("0", "normal", "none") | x.startswith("benign") | x.startswith("normal")


def protocol(value: Column) -> Column:
    x = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(x == "", "OTHER").otherwise(case(x, PROTOCOLS, x))


def protocol_of_flags(tcp: Column, udp: Column, icmp: Column) -> Column:
    return F.when(tcp >= 0.5, "TCP").when(udp >= 0.5, "UDP").when(icmp >= 0.5, "ICMP").otherwise("OTHER")


def rate_band(rate: Column) -> Column:
    return F.when(rate < 1, 0).otherwise(F.least(F.lit(9), F.floor(2 * F.log10(F.greatest(rate, F.lit(1.0)))).cast("int")))


def surrogate_source(rate: Column, syn: Column, ack: Column, fin: Column, rst: Column) -> Column:
    """A stable stand-in address for flows without one: by rate band and flag signature."""
    signature = F.floor(8 * syn + 4 * ack + 2 * fin + rst)
    return F.format_string("10.99.%d.%d", rate_band(rate).cast("int"), F.pmod(signature, F.lit(256)).cast("int"))


SURROGATE_TARGET = "10.99.255.1"


def default_port(https: Column, http: Column, dns: Column) -> Column:
    return F.when(https >= 0.5, 443).when(http >= 0.5, 80).when(dns >= 0.5, 53).otherwise(0)


def flag_bits(fin: Column, syn: Column, rst: Column, psh: Column, ack: Column) -> Column:
    bit = lambda c, k: F.when(c >= 0.5, k).otherwise(0)
    return bit(fin, 1) + bit(syn, 2) + bit(rst, 4) + bit(psh, 8) + bit(ack, 16)


def packet_length(text: Column, default: int = 64) -> Column:
    """A length as an integer from 1 to 65535; what can't be read, and 0, is the default."""
    x = text.try_cast("double")
    whole = F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 9e15), None).otherwise(x.cast("long"))
    return clip(F.coalesce(F.nullif(whole, F.lit(0).cast("long")), F.lit(default).cast("long")), 1, 65535).cast("int")


def family(label: Column, category: Column) -> Column:
    """The traffic family: the label's text, or the category's where the label is only 0 or 1."""
    text, other = F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(category, F.lit("")))
    binary = text.isin("0", "1")
    none = F.lower(other).isin("-", "", "none", "nan")
    return F.when(text == "0", "benign").when(binary & none, "attack").when(binary, other).when(is_benign(label), "benign").otherwise(text)


def cell_class(text: Column) -> Column:
    """missing, infinite, number or text."""
    x = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(x.isin(*MISSING, "?"), "missing").when(x.isin(*INFINITE), "infinite").when(x.try_cast("double").isNotNull(), "number").otherwise("text")


def is_dirty(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*MISSING, "inf", "-inf", "infinity")


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sigmoid(z: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -limit, limit)))


def syn_only(flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(16) == 0)


def linear_head(columns: dict[str, Column]) -> Column:
    """The fixed logistic head over flow features."""
    z = reduce(lambda a, b: a + b, (w * columns[k] for k, w in HEAD_WEIGHTS.items())) + HEAD_BIAS
    return 1 / (1 + F.exp(-z))


def top_contributions(columns: dict[str, Column], top: int = 3) -> Column:
    """The features that contribute most to a weighted sum, largest magnitude first, ties in feature order."""
    items = F.array(*(F.struct((-F.abs(w * columns[k])).alias("size"), F.lit(i).alias("at"), F.lit(k).alias("feature"), F.round(w * columns[k], 3).alias("value")) for i, (k, w) in enumerate(ATTRIBUTION_WEIGHTS.items())))
    return F.transform(F.slice(F.array_sort(items), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))


def trust_modulated(raw: Column, suspicion: Column) -> Column:
    return clip(raw * (1 + 0.6 * (suspicion - 0.5)), 0.0, 1.0)


def suspicion(a: Column, b: Column, seen: Column, width: float = 0.4) -> Column:
    return F.least(F.lit(1.0), b / (a + b) + width * F.sqrt(F.log(seen + 2.0) / (a + b)))


def choose_action(score: Column, high: Column, low: Column, suspect: Column, unknown: Column) -> Column:
    """action and severity; the order of the cases matters."""
    both = lambda a, s: F.struct(F.lit(a).alias("action"), F.lit(s).alias("severity"))
    firm = (score > high) & (suspect > 0.6) & (score - high > 0.12)
    return (
        F.when(unknown & (score > low), both("REDIRECT", "high"))
        .when(firm & (suspect > 0.85), both("QUARANTINE", "critical"))
        .when(firm, both("DROP", "high"))
        .when(score > high, both("RATE_LIMIT", "medium"))
        .when(score > low, both("MIRROR", "low"))
        .otherwise(both("PASS", "info"))
    )


def static_verdict(pps: Column, flags: Column, length: Column, fanout: Column) -> Column:
    """A frozen firewall-like rule, as a baseline."""
    return (pps > 0.8) | ((flags == 2) & (length < 60)) | (fanout > 0.7)


def propensity(would_drop: Column, mirror: float = 0.05, least: float = 0.05) -> Column:
    return F.when(would_drop, max(least, mirror)).otherwise(1.0)


def severity_rank(severity: Column) -> Column:
    return case(F.lower(severity), SEVERITY_RANK, F.lit(0))


def mitigation(action: Column) -> Column:
    return case(action, MITIGATIONS, F.lit("none"))


def imbalance_level(ratio: Column) -> Column:
    """Five levels for a data set profile."""
    return F.when(ratio.isNull() | (ratio == float("inf")), "DEGENERATE").when(ratio < 1.5, "BALANCED").when(ratio < 4, "MILD").when(ratio < 10, "MODERATE").when(ratio < 100, "SEVERE").otherwise("EXTREME")


def imbalance_warning(ratio: Column) -> Column:
    """Four levels for the report before a run."""
    return F.when(ratio.isNull() | (ratio >= 100), "SEVERE").when(ratio >= 10, "HIGH").when(ratio >= 3, "MODERATE").otherwise("BALANCED")


def alert_id(ts: Column, count: Column) -> Column:
    return F.format_string("al-%d-%d", F.pmod(F.floor(ts * 1000), F.lit(10_000_000)).cast("long"), count.cast("long"))


def flow_id(*key: Column) -> Column:
    """A stable 32-bit id of a flow's key, in hexadecimal."""
    return F.lower(F.lpad(F.hex(F.xxhash64(*key).bitwiseAND(0xFFFFFFFF)), 8, "0"))


def multiply32(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 without overflow: by 16-bit limbs."""
    low, high = x.bitwiseAND(65535), F.shiftrightunsigned(x, 16)
    return (low * factor + (high * factor).bitwiseAND(65535) * 65536).bitwiseAND(4294967295)


def mix32(x: Column, seed: int = 0) -> Column:
    """A 32-bit hash of a non-negative integer. Multipliers and shifts are fixed values."""
    h = multiply32(x.cast("long").bitwiseXOR(F.lit(seed).cast("long")).bitwiseAND(4294967295), 0x9E3779B1)
    h = multiply32(h.bitwiseXOR(F.shiftrightunsigned(h, 15)), 0x85EBCA77)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 13))


def leading_zeros32(x: Column) -> Column:
    return F.when(x == 0, 32).otherwise(32 - F.length(F.bin(x)))


def ipv4_number(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.cast("long"))


def rule_predicate(feature: Column, op: Column, threshold: Column, feature2: Column, op2: Column, threshold2: Column) -> Column:
    one = F.format_string("%s %s %.3f", feature, op, threshold)
    return F.when(feature2.isNull(), one).otherwise(F.format_string("%s AND %s %s %.3f", one, feature2, op2, threshold2))


def alert_summary(severity: Column, action: Column, src: Column, dst: Column, score: Column, reason: Column) -> Column:
    return F.format_string("[ALERT] %s %s src=%s dst=%s score=%.4f reason=%s", F.upper(F.coalesce(severity, F.lit("?"))), F.coalesce(action, F.lit("?")), F.coalesce(src, F.lit("?")), F.coalesce(dst, F.lit("?")), score, F.coalesce(reason, F.lit("")))


def cef(severity: Column, action: Column, src: Column, dst: Column, score: Column, reason: Column, vendor: str = "rivulet", product: str = "flows") -> Column:
    """A line in the Common Event Format."""
    level = case(F.lower(severity), CEF_SEVERITY, F.lit(3))
    return F.format_string(f"CEF:0|{vendor}|{product}|1.0|%s|%s|%d|src=%s dst=%s act=%s cs1Label=reason cs1=%s cn1Label=aggregate cn1=%.4f", action, F.substring(reason, 1, 60), level, src, dst, action, reason, score)


def pager_severity(severity: Column) -> Column:
    x = F.lower(severity)
    return F.when(x.isin("critical", "error", "warning", "info"), x).otherwise("warning")


def phi(overdue: Column, mean: Column, deviation: Column, corrected: bool = True) -> Column:
    """Suspicion of a silent peer, by the logistic approximation of the normal tail. Not corrected: the early side as some systems have it, with the tails swapped."""
    y = (overdue - mean) / deviation
    late = F.exp(-y * (1.5976 + 0.070566 * y * y))
    early = F.exp(y * (1.5976 - 0.070566 * y * y))
    p = F.when(y >= 0, late / (1 + late) if corrected else late).otherwise(1 / (1 + F.exp(y * (1.5976 + 0.070566 * y * y))) if corrected else 1 - early)
    return -F.log10(clip(p, 1e-10, 1.0))
