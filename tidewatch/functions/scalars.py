"""Column functions over addresses, amounts, hex words and statuses; none of them raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a provider's message says about the kind of its failure, in the order of the tests.
RATE_WORDS = ["rate limit", "too many requests", "too many request", "429", "compute units", "cu limit", "exceeded", "over rate", "capacity", "throttl", "slow down", "temporarily unavailable", "try again", "call rate", "credits", "quota", "limit reached", "projected cu"]
AUTH_WORDS = ["unauthorized", "forbidden", "invalid api key", "missing api key", "api key required", "access token", "authentication required", "project id"]
RANGE_WORDS = ["block range", "query returned more", "response size", "log response size", "more than", "range limit", "too many results", "timeout", "timed out", "-32602"]
# Groups of request methods; any other method counts as head.
METHOD_GROUPS = {
    "eth_chainId": "head",
    "eth_blockNumber": "head",
    "eth_getBlockByNumber": "blocks",
    "eth_getTransactionReceipt": "receipts",
    "eth_getBlockReceipts": "receipts",
    "eth_getLogs": "logs",
    "eth_getCode": "code",
    "eth_getBalance": "balance",
    "eth_call": "eth_call",
}
DAY = 86400
# Seconds until a failed chain is read again, by failures in a row.
FAILURE_DELAYS = [1800, 7200, 28800, DAY, 3 * DAY]


def evm_address(c: Column) -> Column:
    """Lower-case 0x + 40 hex digits; anything else is null."""
    low = F.lower(c)
    return F.when(low.rlike("^0x[0-9a-f]{40}$"), low)


def sui_id(c: Column) -> Column:
    """0x + 64 hex digits with leading zeros; 1 to 64 digits are accepted with or without 0x.

    Plain text functions: patterns are slow where they are not compiled once, as inside of lambdas.  There
    each mention of a column is worked out again too, so digits are named once: unhex is null for others.
    """
    text = F.trim(c)
    id_of = lambda digits: F.concat(F.lit("0x"), F.lower(F.hex(F.unhex(F.lpad(digits, 64, "0")))))
    prefixed = F.lower(F.substring(text, 1, 2)) == "0x"
    return F.when(prefixed, F.when(F.length(text).between(3, 66), id_of(F.substring(text, 3, 1 << 30)))).when(F.length(text).between(1, 64), id_of(text))


def coin_type(c: Column) -> Column:
    """package::module::NAME with a normalized package; fewer than three parts are null."""
    parts = F.split(c, "::")
    head = sui_id(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) >= 3) & head.isNotNull(), F.concat_ws("::", head, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "::")))


def topic_address(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(c, F.lit(40))))


def pad_address(c: Column) -> Column:
    return F.lpad(F.regexp_replace(F.lower(c), "0x", ""), 64, "0")


def hex_to_long(c: Column) -> Column:
    """Hex to integer; null, empty and 0x are 0; more than 63 bits or bad digits are null."""
    digits = F.regexp_replace(F.lower(c), "^0x", "")
    short = F.regexp_replace(digits, "^0+", "")
    value = F.conv(F.when(short.rlike("^[0-9a-f]{1,15}$") | short.rlike("^[0-7][0-9a-f]{15}$"), short), 16, 10).cast("bigint")
    return F.when(c.isNull() | (F.coalesce(short, F.lit("")) == ""), F.when(F.coalesce(digits, F.lit("")).rlike("^[0-9a-f]*$"), F.lit(0).cast("bigint"))).otherwise(value)


def hex_to_double(digits: Column) -> Column:
    """Up to 64 hex digits as a double, 32 bits at a time."""
    padded = F.lpad(digits, 64, "0")
    value = F.lit(0.0)
    for k in range(8):
        value = value * 4294967296.0 + F.conv(F.substring(padded, 8 * k + 1, 8), 16, 10).cast("double")
    return value


def abi_uint256(c: Column) -> Column:
    """Value of a response that is exactly one 32-byte word, as a double; anything else is null."""
    return F.when(c.rlike("^0x[0-9a-fA-F]{64}$"), hex_to_double(F.lower(F.substring(c, 3, 64))))


def abi_uint256_text(c: Column) -> Column:
    """Canonical hex text of a valid word: no leading zeros, so equal values have equal text."""
    digits = F.regexp_replace(F.lower(F.substring(c, 3, 64)), "^0+", "")
    return F.when(c.rlike("^0x[0-9a-fA-F]{64}$"), F.concat(F.lit("0x"), F.when(digits == "", "0").otherwise(digits)))


def abi_uint256_decimal(c: Column) -> Column:
    """Exact decimal text of a valid word, of any size: long arithmetic on limbs of nine digits, eight hex digits at a time.

    Words of up to 15 and 30 digits, as nearly all are, fit a bigint and a decimal and need none of that.
    """
    base, zero = 10**9, F.array(*[F.lit(0).cast("bigint")] * 9)
    pieces = F.array(*(F.conv(F.substring(c, 3 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)))

    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))

    def times(limbs: Column, piece: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), piece.alias("carry"))
        step = lambda s, x: F.struct(F.concat(s["out"], F.array((x * F.lit(1 << 32) + s["carry"]) % base)).alias("out"), div(x * F.lit(1 << 32) + s["carry"], base).alias("carry"))
        return F.aggregate(limbs, start, step, lambda s: s["out"])

    digits = F.array_join(F.transform(F.reverse(F.aggregate(pieces, zero, times)), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    low = F.conv(F.substring(c, 52, 15), 16, 10)
    both = F.conv(F.substring(c, 37, 15), 16, 10).cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    zeros = lambda n: F.substring(c, 3, n) == "0" * n
    return F.when(c.rlike("^0x[0-9a-fA-F]{64}$"), F.when(zeros(49), low).when(zeros(34), both.cast("string")).otherwise(plain))


def abi_string(c: Column) -> Column:
    """Text of a string response: with offset 32 and a length, or zero-padded bytes."""
    valid = c.rlike("^0x([0-9a-fA-F]{2})*$") & (F.length(c) >= 66)
    body = F.substring(c, 3, 1 << 30)
    dynamic = (F.length(c) >= 130) & F.substring(body, 1, 64).rlike("^0{62}20$")
    length = F.least(hex_to_long(F.substring(body, 65, 64)), F.length(body) / 2).cast("int")
    text = F.try_to_binary(F.substr(body, F.lit(129), 2 * length), F.lit("hex"))
    fixed = F.try_to_binary(F.regexp_extract(F.substring(body, 1, 64), "^((?:(?!00)[0-9a-fA-F]{2})*)", 1), F.lit("hex"))
    utf8 = lambda b: F.decode(b, "UTF-8")
    clean = F.regexp_replace(utf8(text), "^\\x00+|\\x00+$", "")
    return F.when(valid & dynamic, clean).when(valid, F.when(F.length(fixed) > 0, utf8(fixed)))


def has_bytecode(c: Column) -> Column:
    """1 or 0 for hex code of whole bytes, all zeros count as none; bad input is null: unknown."""
    return F.when(c.rlike("^0x([0-9a-fA-F]{2})*$"), F.when(c.rlike("[1-9a-fA-F]") & (F.regexp_replace(c, "^0x0*", "") != ""), 1).otherwise(0))


def scale_amount(raw: Column, decimals: Column) -> Column:
    return F.when(decimals.between(0, 36), raw.cast("double") / F.pow(F.lit(10.0), decimals.cast("double")))


def price_key(chain: Column, token: Column, native_id: Column) -> Column:
    return F.when(token.isNull(), F.concat(F.lit("coingecko:"), native_id)).otherwise(F.concat(chain, F.lit(":"), F.lower(token)))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def suspicious_usd(v: Column, threshold: float) -> Column:
    return v.isNotNull() & (~finite(v) | (v >= threshold))


def nonneg(c: Column) -> Column:
    """A finite number of at least 0, else null."""
    v = c.try_cast("double")
    return F.when(finite(v) & (v >= 0), v)


def any_word(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def classify_error(status: Column, body: Column) -> Column:
    """rate_limit, auth, range, http or null, tested in this order."""
    text = F.lower(F.coalesce(body, F.lit("")))
    code = F.coalesce(status, F.lit(0))
    return (
        F.when((code == 429) | any_word(text, RATE_WORDS), "rate_limit")
        .when(code.isin(401, 403) | any_word(text, AUTH_WORDS), "auth")
        .when(any_word(text, RANGE_WORDS), "range")
        .when(code >= 400, "http")
    )


def retry_after(header: Column) -> Column:
    """Seconds that a Retry-After header asks for, at least 1; null if it is no number."""
    return F.greatest(F.lit(1.0), header.try_cast("double")) if header is not None else F.lit(None)


def method_group(method: Column) -> Column:
    out = F.lit("head")
    for name, group in METHOD_GROUPS.items():
        out = F.when(method == name, group).otherwise(out)
    return out


def retry_delay(status: Column, has_code: Column, usd: Column, threshold: float, streak: Column) -> Column:
    """Seconds until a chain of an address is read again."""
    step = F.least(F.greatest(F.coalesce(streak, F.lit(0)) - 1, F.lit(0)), F.lit(4)).cast("int")
    amount = F.coalesce(usd, F.lit(0.0))
    return (
        F.when(status.isin("rpc_error", "partial", "timeout"), F.get(F.array(*map(F.lit, FAILURE_DELAYS)), step))
        .when(status == "price_missing", 30 * DAY)
        .when(status == "anomalous_balance", DAY)
        .when((F.coalesce(has_code, F.lit(1)) == 0) | (status == "absent"), 90 * DAY)
        .when(amount >= threshold, DAY)
        .when(amount >= 150_000, 3 * DAY)
        .when(amount > 0, 30 * DAY)
        .otherwise(90 * DAY)
    )


def token_valuation(usd: Column, policy: Column, threshold: float) -> Column:
    """How a token balance counts: a policy that shuts it out, anomalous_balance, or included."""
    return (
        F.when(policy.isin("exclude_from_total", "quarantine"), policy)
        .when(suspicious_usd(usd, threshold) & ~policy.eqNullSafe(F.lit("include_verified")), "anomalous_balance")
        .otherwise("included")
    )


def native_valuation(usd: Column, policy: Column, threshold: float, retry: bool = False) -> Column:
    """The same for a native balance: include exempts it too, but not on a retry."""
    exempt = ["include_verified"] if retry else ["include", "include_verified"]
    return (
        F.when(policy.isin("exclude_from_total", "quarantine"), policy)
        .when((usd >= threshold) & ~F.coalesce(policy.isin(*exempt), F.lit(False)), "anomalous_balance")
        .otherwise("included")
    )


def chain_status(rpc_error: Column, anomaly: Column, unpriced: Column) -> Column:
    return F.when(rpc_error, "partial").when(anomaly, "anomalous_balance").when(unpriced, "price_missing").otherwise("complete")


def coverage_state(completed: Column, history_limited: Column, overdue: Column) -> Column:
    """State of a contract's token history; no task (all null) counts as verified."""
    return (
        F.when(F.coalesce(history_limited, F.lit(False)), "history_unknown")
        .when(history_limited.isNotNull() & completed.isNull(), "historical_pending")
        .when(F.coalesce(overdue, F.lit(False)), "recent_only")
        .otherwise("verified")
    )


def address_status(total: Column, parts: Column, all_verified: Column, min_usd: float) -> Column:
    """qualifying by total first; below only if there are parts and all are verified; else incomplete."""
    return F.when(total >= min_usd, "qualifying").when((parts > 0) & all_verified, "below").otherwise("incomplete")


def project_status(tvl: Column, packages: Column, policy: Column, min_usd: float, anomaly_usd: float) -> Column:
    """Struct (status, valuation): quarantined, missing or unmapped projects are incomplete."""
    valid = finite(tvl)
    bad = F.coalesce(policy == "quarantine", F.lit(False)) | (
        tvl.isNotNull() & (~valid | (tvl >= anomaly_usd)) & ~(policy.eqNullSafe(F.lit("include_verified")) & valid)
    )
    status = F.when(~F.coalesce(valid, F.lit(False)) | (F.size(packages) == 0) | bad, "incomplete").when(tvl >= min_usd, "qualifying").otherwise("below")
    return F.struct(status.alias("status"), F.when(bad, "anomalous_balance").otherwise("included").alias("valuation"))


def current_project_status(status: Column, complete: Column, packages: Column, age_seconds: Column, tvl: Column, min_usd: float) -> Column:
    """Status as of now: data older than 1800 s counts as incomplete."""
    return F.when((status == "incomplete") | ~complete | (packages == 0) | (age_seconds > 1800), "incomplete").when(F.coalesce(tvl, F.lit(0.0)) >= min_usd, "qualifying").otherwise("below")


def packed(c: Column) -> Column:
    """A text as bytes, half as many for 0x and pairs of small hex digits as addresses have; equal texts and no others have equal bytes."""
    digits = F.substring(c, 3, 1 << 30)
    halves = F.unhex(digits)  # null where these are no hex digits; compared with the text, as it takes odd numbers of digits and large ones too
    return F.when(F.startswith(c, F.lit("0x")) & F.coalesce(F.lower(F.hex(halves)) == digits, F.lit(False)), F.concat(F.lit(b"\x01"), halves)).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpacked(c: Column) -> Column:
    """The text of packed bytes."""
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.concat(F.lit("0x"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def raw_positive(c: Column) -> Column:
    """Whether a decimal text of any length is above 0."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^0+", "").rlike("^[0-9]+$")


def minute_bucket(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def span_seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b, never negative, 0 where either is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6), F.lit(0.0))


def endpoint_fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def endpoint_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def legacy_scan_status(total: Column, min_usd: float) -> Column:
    return F.when(F.coalesce(total, F.lit(0.0)) <= 0, "zero").when(total >= min_usd, "qualifying").otherwise("below")


def sui_retry_delay(quota: Column, failures: Column) -> Column:
    n = F.greatest(F.coalesce(failures, F.lit(1)) - 1, F.lit(0))
    return F.when(quota, F.least(F.lit(7200.0), 900 * F.pow(F.lit(2.0), n))).otherwise(F.least(F.lit(900.0), 30 * F.pow(F.lit(2.0), n))).cast("long")
