"""Matching entities across sources without keys, by a cascade of exact joins.

Each rule is an equi-join of listings and organisations on some attributes; rules run from the strongest combination to
the weakest, and a listing that some rule has matched is anti-joined away from the weaker ones. A typing error is met by
exact joins too, on the first and on the last letters, one of which it leaves as they are.

The confidence of a rule is its precision on labelled pairs, smoothed towards the precision of all rules together. Labels
come from evidence the rule does not join on: a registration hint that agrees with one of the organisation's identifiers or
with none, and for the rule that joins on the hint the phones of both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.gazetteer import complete_places
from ledgerloom.llm.spelling import address_parts, affixes, name_parts, one_edit, same_trade, state_of, town_of
from ledgerloom.session import Stash

PHONE_DIGITS = 9
#: Digits of a registration hint that are joined on; a hint with fewer tells nothing.
HINT_DIGITS = 4
#: Pseudo-count of labelled pairs, at the precision of all rules together, that every rule starts with.
PRIOR_WEIGHT = 9.0


def phone_key(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(PHONE_DIGITS)))


def listing_keys(listings: DataFrame) -> DataFrame:
    """One row per listing id (of rows with one id the first in sort order): components in one spelling."""
    rows = listings.where("listing_id is not null").groupBy("listing_id").agg(
        F.min(F.struct("listing_name", "town", "state_name", "postcode", "phone", "registration_hint")).alias("r"))
    return rows.select("listing_id", "r.*").withColumn("n", name_parts("listing_name")).select(
        "listing_id", "n.stem", "n.trade", town_of("town").alias("town"), state_of("state_name").alias("state"),
        F.coalesce(F.regexp_replace("postcode", r"\D", ""), F.lit("")).alias("postcode"), phone_key(F.col("phone")).alias("phone"),
        "registration_hint").where("stem <> ''")


def organisation_names(organisations: DataFrame) -> DataFrame:
    """(org_id, stem, trade) of each name an organisation is recorded under."""
    names = F.array_compact(F.concat(F.array("canonical_name", "legal_name"), F.coalesce("trading_names", F.array().cast("array<string>"))))
    rows = organisations.where("org_id is not null").select("org_id", F.explode(F.array_distinct(names)).alias("name")).distinct()
    return rows.withColumn("n", name_parts("name")).select("org_id", "n.stem", "n.trade").where("stem <> ''").distinct()


def organisation_places(locations: DataFrame, observations: DataFrame) -> DataFrame:
    """(org_id, town, state, postcode) from recorded addresses and observed localities."""
    parts = locations.select("org_id", "address_lines", "locality", "region", "postal_code").distinct().withColumn(
        "a", address_parts("address_lines", "locality", "region", "postal_code")).select("org_id", "a.town", "a.state", "a.postcode")
    seen = observations.where("predicate = 'location' and normalisation_status <> 'rejected'").select(
        "org_id", F.get_json_object("object_value", "$.locality").alias("town"), F.get_json_object("object_value", "$.region").alias("state")).distinct()
    observed = seen.select("org_id", town_of("town").alias("town"), state_of("state").alias("state"), F.lit("").alias("postcode"))
    return parts.unionByName(observed).where("org_id is not null and (town <> '' or postcode <> '')").distinct()


def hint_text(hint: Column) -> Column:
    """The letters and digits of a hint without its words; null with fewer than ``HINT_DIGITS`` digits."""
    text = F.upper(F.regexp_replace(hint, r"[A-Za-z]{2,}|[^A-Za-z0-9]", ""))
    return F.when(F.length(F.regexp_replace(text, r"\D", "")) >= HINT_DIGITS, text)


def hint_fits(hint: Column, value: Column) -> Column:
    """The hint stands where it says in the identifier: at its start where it ends in ``***``, else at its end. False for a
    hint that tells nothing."""
    text = hint_text(hint)
    return F.coalesce(F.when(hint.endswith("***"), value.startswith(text)).otherwise(value.endswith(text)), F.lit(False))


def _hint_end(text: Column, at_start: Column) -> Column:
    return F.when(at_start, F.concat(F.lit("<"), F.left(text, F.lit(HINT_DIGITS)))).otherwise(F.concat(F.lit(">"), F.right(text, F.lit(HINT_DIGITS))))


def near_stem(a: Column, b: Column) -> Column:
    """Equal, or one edit or swap apart and of three letters or more."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 3) & one_edit(a, b))


def _passes() -> list[tuple[list[str], str, list[tuple[str, Column]]]]:
    """Passes from the strongest to the weakest: attributes joined on (``~`` marks those joined on an affix), the column that
    must not be blank, and the rules a joined pair may meet, the first that holds counting. ``initial`` is that of the trade."""
    l_, o_ = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"o_{c}"))
    same, near = l_("stem") == o_("stem"), near_stem(l_("stem"), o_("stem"))
    town_fits = (l_("town") == "") | (o_("town") == "") | one_edit(l_("town"), o_("town"))
    return [
        (["stem", "town"], "town", [("name_trade_town", same)]),
        (["stem", "postcode"], "postcode", [("name_trade_postcode", town_fits)]),
        (["~stem", "initial", "town"], "town", [("near_name_trade_town", near)]),
        (["~stem", "initial", "postcode"], "postcode", [("near_name_trade_postcode", near & town_fits)]),
        (["~stem", "initial", "~town"], "town", [("near_name_trade_near_town", near & one_edit(l_("town"), o_("town")))]),
    ]


def match(listings: DataFrame, organisations: DataFrame, identifiers: DataFrame, locations: DataFrame, observations: DataFrame) -> DataFrame:
    """``(org_id, listing_id, rule, confidence)``: of every listing all pairs of the strongest rule it meets.

    Nulls in any attribute only keep a row out of the rules that join on it; names without any word match nothing, and a name
    that gives no trade contradicts none. Repeated rows count once, ties do not arise as every pair that meets the rule is
    kept, empty tables give an empty result, and other columns of the tables are ignored. No candidate or partner is capped.
    Places are part of every key but those of listings or organisations without any, so namesakes elsewhere are never
    compared; those without a place are joined on phone, or on name and hint.
    """
    stash = Stash(listings.sparkSession)
    initial = F.left("trade", F.lit(1))
    places = stash.put(organisation_places(locations, observations))
    side_l = stash.put(complete_places(listing_keys(listings), places, stash).withColumn("initial", initial))
    places = complete_places(places, places, stash).distinct()
    side_o = stash.put(organisation_names(organisations).join(places, "org_id", "left").fillna("", ["town", "state", "postcode"]).withColumn("initial", initial))
    phones = stash.put(observations.where("predicate = 'phone'").select("org_id", phone_key(F.col("object_value")).alias("phone")).where("phone is not null").distinct())
    value = F.regexp_replace(F.upper(F.coalesce("value_normalised", "value")), "[^A-Z0-9]", "")
    numbers = stash.put(identifiers.where("org_id is not null").select("org_id", value.alias("value")).where("length(value) >= 6").distinct())

    def keyed(df: DataFrame, attributes: list[str], keep: list[str], prefix: str) -> DataFrame:
        parts = []
        for a in attributes:
            if a[0] == "~":
                df = df.withColumn(f"__{a[1:]}", F.explode(affixes(F.col(a[1:]))))
                parts.append(F.col(f"__{a[1:]}"))
            else:
                parts.append(F.col(a))
        return df.select(F.xxhash64(*parts).alias("key"), *[F.col(c).alias(prefix + c) for c in keep]).distinct()

    def first_rule(joined: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
        """The rule of each pair; trades are compared last, for the pairs that the built-in checks leave."""
        rule = reduce(lambda w, r: w.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
        named = joined.withColumn("rule", rule).where("rule is not null").select(
            F.col("o_org_id").alias("org_id"), F.col("l_listing_id").alias("listing_id"), "rule", F.col("l_trade").alias("a"), F.col("o_trade").alias("b")).distinct()
        return named.where((F.col("a") == F.col("b")) | same_trade("a", "b")).select("org_id", "listing_id", "rule").distinct()

    found: list[DataFrame] = []

    def settle(pairs: DataFrame) -> None:
        """Keep what a pass has found; its listings are resolved and leave the later passes."""
        nonlocal open_l
        found.append(stash.put(pairs))
        open_l = open_l.join(found[-1].select("listing_id").distinct(), "listing_id", "left_anti")

    open_l = side_l
    keep = ["stem", "trade", "town", "postcode"]
    for attributes, filled, rules in _passes():
        a = keyed(open_l.where(F.col(filled) != ""), attributes, ["listing_id", *keep], "l_")
        b = keyed(side_o.where(F.col(filled) != ""), attributes, ["org_id", *keep], "o_")
        settle(first_rule(a.join(b, "key"), rules))

    far = F.levenshtein("l_stem", "o_stem") <= 3
    states = (F.col("l_state") == "") | (F.col("o_state") == "") | (F.col("l_state") == F.col("o_state"))
    blank = "town = '' and postcode = ''"
    keep = ["stem", "trade", "state"]
    open_l = stash.put(open_l)
    rung, reached = open_l.where("phone is not null"), side_o.join(phones, "org_id")
    tries = [(rung.where(f"{c} <> ''"), reached.where(f"{c} <> ''"), ["phone", "initial", c], far) for c in ("town", "postcode")]
    tries += [(rung.where(blank), reached, ["phone", "initial"], far & states), (rung.where(f"not ({blank})"), reached.where(blank), ["phone", "initial"], far & states)]
    settle(reduce(DataFrame.unionByName, [
        first_rule(keyed(x, on, ["listing_id", *keep], "l_").join(keyed(y, on, ["org_id", *keep], "o_"), "key"), [("trade_phone", rule)]) for x, y, on, rule in tries]).distinct())

    # without any place on one side, a registration hint must bear out the name
    hinted = open_l.where(hint_text(F.col("registration_hint")).isNotNull()).withColumn(
        "end", _hint_end(hint_text(F.col("registration_hint")), F.col("registration_hint").endswith("***")))
    numbered = side_o.join(numbers, "org_id")
    ends = lambda df: df.withColumn("end", F.explode(F.array(_hint_end(F.col("value"), F.lit(True)), _hint_end(F.col("value"), F.lit(False)))))
    tries = []
    for left, right in ((hinted.where(blank), numbered), (hinted.where(f"not ({blank})"), numbered.where(blank))):
        a = keyed(left, ["~stem", "initial", "end"], ["listing_id", "registration_hint", *keep], "l_")
        b = keyed(ends(right), ["~stem", "initial", "end"], ["org_id", "value", *keep], "o_")
        fits = states & near_stem(F.col("l_stem"), F.col("o_stem")) & hint_fits(F.col("l_registration_hint"), F.col("o_value"))
        tries.append(first_rule(a.join(b, "key"), [("near_name_trade_hint", fits)]))
    settle(tries[0].unionByName(tries[1]).distinct())

    return with_confidence(reduce(DataFrame.unionByName, found), side_l, numbers, phones)


def with_confidence(pairs: DataFrame, listings: DataFrame, numbers: DataFrame, phones: DataFrame) -> DataFrame:
    """Adds the smoothed precision of each rule on its labelled pairs.

    Labelled are pairs whose listing has a registration hint that tells something and whose organisation has an identifier:
    right if the hint fits one of them. Pairs of the rule that joins on the hint are labelled by phone instead, where both
    sides have one. Without any labelled pair the confidence is a half."""
    by_hint = pairs.where("rule <> 'near_name_trade_hint'").join(
        listings.where(hint_text(F.col("registration_hint")).isNotNull()).select("listing_id", "registration_hint"), "listing_id").join(numbers, "org_id").select(
        "rule", "org_id", "listing_id", hint_fits(F.col("registration_hint"), F.col("value")).alias("hit"))
    by_phone = pairs.where("rule = 'near_name_trade_hint'").join(
        listings.where("phone is not null").select("listing_id", F.col("phone").alias("p")), "listing_id").join(phones, "org_id").select(
        "rule", "org_id", "listing_id", (F.col("p") == F.col("phone")).alias("hit"))
    labelled = by_hint.unionByName(by_phone).groupBy("rule", "org_id", "listing_id").agg(F.bool_or("hit").alias("hit"))
    counts = {r["rule"]: (r["good"], r["n"]) for r in labelled.groupBy("rule").agg(F.count_if("hit").alias("good"), F.count("*").alias("n")).collect()}  # one row per rule
    whole = sum(n for _, n in counts.values())
    prior = sum(g for g, _ in counts.values()) / whole if whole else 0.5
    smooth = {r: (g + PRIOR_WEIGHT * prior) / (n + PRIOR_WEIGHT) for r, (g, n) in counts.items()}
    confidence = reduce(lambda w, r: w.when(F.col("rule") == r, F.lit(round(smooth[r], 4))), smooth, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(round(prior, 4)))
    return pairs.select("org_id", "listing_id", "rule", confidence.alias("confidence"))
