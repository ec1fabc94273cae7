"""Same postal address written differently: a set-containment join on address components.

Addresses are parsed into components and written in one spelling; towns are mended and filled by the table's own
gazetteer, misspelt streets by the other addresses at their number and town. Each distinct form is then a set of tokens,
one per face (box, street) and set of optional parts. Each form is indexed under its rarest token only, fuller forms probe
with all of theirs, and a candidate is kept if enough of the lesser form's weight is contained in the fuller one and no
component contradicts. A form that lacks its town or street type denotes a place only if all fuller forms that hold it
denote that one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.gazetteer import complete_places
from ledgerloom.llm.spelling import address_parts, affixes, one_edit, shortened
from ledgerloom.session import Stash, pairs_within, salted_join

FORM = ("box", "unit", "number", "street", "type", "direction", "town")
#: Fixed weights of the components by how much they tell, and the least share of the lesser form's weight the fuller must hold.
WEIGHTS = {"box": 4.0, "number": 2.0, "unit": 2.0, "street": 4.0, "type": 1.0, "direction": 1.0, "town": 3.0}
CONTAINED = 0.8
#: Parts of a street address that are the same or it is another one, blank or not; the others may be missing.
STRICT = ("unit", "direction")
KINDS = ("box", "street")


def parsed_locations(locations: DataFrame) -> DataFrame:
    """One row of components per distinct writing of each location."""
    rows = locations.where("location_id is not null").select("location_id", "address_lines", "locality", "region", "postal_code").distinct()
    return rows.withColumn("a", address_parts("address_lines", "locality", "region", "postal_code")).select("location_id", "a.*").where(
        "box <> '' or (number <> '' and street <> '')")


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("|", *parts)


def same_street(x: Column, y: Column) -> Column:
    """Equal but for typing errors: one, two from six letters on, three from eight."""
    short = F.least(F.length(x), F.length(y))
    return (F.levenshtein(x, y) <= F.when(short >= 8, 3).when(short >= 6, 2).otherwise(1)) | one_edit(x, y)


def mended_streets(forms: DataFrame, stash: Stash) -> DataFrame:
    """``forms`` (form, n, components) with the street and town of the form they are a misspelling of.

    Two forms are spellings of one if number, unit, type and direction are the same, and the street is but for typing errors
    in one town, or the town is in one street. Candidates meet on composite tokens that leave out the head or the tail of
    the street or of the town, one of which a typing error leaves as it is. A form is written as the neighbour that most
    locations have, then the one with most neighbours; only direct neighbours count, so no chain of errors joins two streets.
    A form without a town takes the one near street at its number, if there is only one.
    """
    premises = ("number", *STRICT, "type")
    whole = forms.where("street <> '' and town <> ''")
    ends = lambda head, text: F.transform(affixes(F.col(text)), lambda e: F.xxhash64(*head, e))
    tokens = F.concat(ends((F.lit("street"), *premises, "town"), "street"), ends((F.lit("town"), *premises, "street"), "town"))
    rows = stash.put(whole.select("form", F.explode(tokens).alias("token")))
    # most tokens are held by one form; the others, all of them, are paired: which of its tokens a form shares with its
    # misspelling cannot be told from how rare they are
    live = stash.put(rows.join(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "token", "left_semi"))
    pairs = live.select("token", F.col("form").alias("x")).join(live.select("token", F.col("form").alias("y")), "token").where("x < y").select("x", "y").distinct()
    side = lambda p: whole.select(F.col("form").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in (*premises, "street", "town")])
    same = lambda c: F.col(f"x_{c}") == F.col(f"y_{c}")
    near = (same("town") & same_street(F.col("x_street"), F.col("y_street"))) | (same("street") & one_edit(F.col("x_town"), F.col("y_town")))
    found = stash.put(pairs.join(side("x"), "x").join(side("y"), "y").where(reduce(lambda p, q: p & q, map(same, premises)) & near).select("x", "y"))
    links = found.select(F.col("x").alias("form"), F.col("y").alias("other")).unionByName(found.select(F.col("y").alias("form"), F.col("x").alias("other")))
    rank = stash.put(links.groupBy("form").agg(F.count("*").alias("degree")).join(whole.select("form", "n", "street", "town"), "form").select(
        "form", F.struct("n", "degree", "form", "street", "town").alias("r")))
    best = links.join(rank.select(F.col("form").alias("other"), "r"), "other").groupBy("form").agg(F.max("r").alias("best"))
    fixed = best.join(rank, "form").where("best > r").select("form", F.col("best.street").alias("as_street"), F.col("best.town").alias("as_town"))
    mended = stash.put(forms.join(fixed, "form", "left").withColumns({
        "street": F.coalesce("as_street", "street"), "town": F.coalesce("as_town", "town")}).drop("as_street", "as_town"))

    spelt = lambda df: df.withColumn("token", F.explode(F.transform(shortened(F.col("street")), lambda s: _joined(*premises, s))))
    known = spelt(mended.where("street <> '' and town <> ''")).groupBy("token").agg(F.min("street").alias("least"), F.max("street").alias("most"))
    open_forms = spelt(mended.where("street <> '' and town = ''")).join(known, "token").groupBy("form").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    only = open_forms.where("least = most").select("form", F.col("least").alias("as_street"))
    return mended.join(only, "form", "left").withColumn("street", F.coalesce("as_street", "street")).drop("as_street")


def _face_tokens(face: str, core: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    """Tokens of a face, one for each set of its filled optional parts; the first has all that are filled."""
    sets = [tuple(c for i, c in enumerate(optional) if not k >> i & 1) for k in range(1 << len(optional))]
    part = lambda c, on: F.col(c) if on else F.lit("")
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(face), *core, *[part(c, c in on) for c in optional]) for on in sets]))


def _tokens(box: str = "box", street: str = "street") -> Column:
    """(kind, token, own) of a form: the tokens of its faces; own marks the one with all filled parts of its face."""
    none = F.array().cast("array<struct<kind:string,token:bigint,own:boolean>>")
    face = lambda kind, tokens: F.when(F.col(kind) != "", F.transform(tokens, lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("token"), (i == 0).alias("own")))).otherwise(none)
    return F.concat(face("box", _face_tokens("box", ("box",), ("town",))), face("street", _face_tokens("street", ("number", "street", *STRICT), ("town", "type"))))


def _contained(x: str, y: str) -> Column:
    """Enough of the weight of the form with columns ``x.…`` is held by the one with ``y.…``, and nothing contradicts: no part
    that both have differs, nor, where both have a street, one of the strict parts."""
    at = lambda p, c: F.col(f"{p}.{c}")
    streets = (at(x, "street") != "") & (at(y, "street") != "")
    clash = [at(x, c) != at(y, c) if c in STRICT else (at(x, c) != "") & (at(y, c) != "") & (at(x, c) != at(y, c)) for c in FORM]
    clash = [streets & k if c in STRICT else k for c, k in zip(FORM, clash)]
    held = sum(F.when((at(x, c) != "") & (at(x, c) == at(y, c)), w).otherwise(0.0) for c, w in WEIGHTS.items())
    return ~reduce(lambda p, q: p | q, clash) & (held >= CONTAINED * at(x, "weight"))


def containments(forms: DataFrame, stash: Stash) -> DataFrame:
    """``(x, y, kind)``, structs of the form and its components: the lesser form x is contained in the fuller y.

    ``forms``: form and components, distinct. x is indexed under its rarest token of those with all filled parts of a face,
    y probes with all its tokens; y has more weight. Tokens are hashed; what they stand for is compared in the end.
    """
    weight = sum(F.when(F.col(c) != "", w).otherwise(0.0) for c, w in WEIGHTS.items())
    both = (F.col("box") != "") & (F.col("street") != "")
    lacks = ((F.col("box") != "") | (F.col("street") != "")) & ((F.col("town") == "") | ((F.col("street") != "") & (F.col("type") == "")))
    known = forms.withColumn("f", F.struct("form", weight.alias("weight"), *FORM)).withColumn("both", both).withColumn("lacks", lacks)
    spread = lambda df: df.select("f", "both", "lacks", F.explode(_tokens()).alias("t")).select("f", "both", "lacks", "t.*")
    # a form of one face has one token with all its parts; of those of both faces the rarer is looked up
    two = spread(known.where("both")).where("own")
    counts = spread(known).select("token").join(two.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = two.join(counts, "token").groupBy("f.form").agg(F.min(F.struct("df", "token", "kind", "f")).alias("r")).select("r.token", "r.kind", F.col("r.f").alias("x"))
    single = lambda where: spread(known.where(f"not both and {where}")).where("own").select("token", "kind", F.col("f").alias("x"))
    # what lacks a part is held by fuller forms under a token without it; what lacks none, only by forms that have both faces
    own_two = two.select("token", F.col("f").alias("y"))
    parts = spread(known).where("not own").select("token", F.col("f").alias("y")).unionByName(own_two)
    few = stash.put(single("lacks").unionByName(rarest))
    joined = few.join(parts, "token").unionByName(single("not lacks").join(own_two, "token"))
    return joined.where("y.weight > x.weight").where(_contained("x", "y")).select("x", "y", "kind").distinct()


def _place(kind: str, p: str = "") -> Column:
    """The place a form denotes by one face; null if the face is missing or lacks its town or street type."""
    at = lambda c: F.col(f"{p}{c}")
    if kind == "box":
        return F.when((at("box") != "") & (at("town") != ""), _joined(F.lit("box"), at("box"), at("town")))
    parts = ("number", "street", "type", *STRICT, "town")
    return F.when((at("street") != "") & (at("town") != "") & (at("type") != ""), _joined(F.lit("street"), *[at(c) for c in parts]))


def place_groups(locations: DataFrame, stash: Stash) -> DataFrame:
    """``(location_id, kind, place, other)``: locations with one place denote the same premises by that face, box or street;
    ``other`` is the place of the other face, where the address has both."""
    parsed = stash.put(parsed_locations(locations))
    full = complete_places(parsed, parsed.select("town", "postcode"), stash)
    placed = stash.put(full.select("location_id", *FORM, F.md5(_joined(*FORM)).alias("form")))
    written = stash.put(placed.groupBy("form", *FORM).agg(F.countDistinct("location_id").alias("n")))
    spelt = stash.put(mended_streets(written, stash).withColumn("spelt", F.md5(_joined(*FORM))))
    distinct = stash.put(spelt.select(F.col("spelt").alias("form"), *FORM).distinct())
    held = stash.put(containments(distinct, stash))
    faces = []
    for kind in KINDS:
        own = distinct.select("form", _place(kind).alias("own"), (F.col(kind) != "").alias("has"))
        # a face that lacks a part: the one place of the fuller forms that hold it
        fuller = held.where(F.col("kind") == kind).groupBy(F.col("x.form").alias("form")).agg(
            F.min(_place(kind, "y.")).alias("least"), F.max(_place(kind, "y.")).alias("most"))
        found = own.where("has").join(fuller, "form", "left").withColumn(
            "place", F.coalesce("own", F.when(F.col("least") == F.col("most"), F.col("least")))).where("place is not null")
        faces.append(found.select("form", F.lit(kind).alias("kind"), "place"))
    both = faces[0].unionByName(faces[1])
    per_form = both.groupBy("form").agg(F.collect_list(F.struct("kind", "place")).alias("faces"))  # at most two
    named = spelt.select(F.col("form"), "spelt").join(per_form.withColumnRenamed("form", "spelt"), "spelt").select("form", "faces")
    rows = salted_join(placed.select("location_id", "form"), stash.put(named), "form", how="inner")
    return rows.select("location_id", F.explode("faces").alias("at"), "faces").select(
        "location_id", "at.kind", "at.place", F.get(F.filter("faces", lambda f: f["kind"] != F.col("at.kind")), F.lit(0))["place"].alias("other")).distinct()


def same_places(locations: DataFrame) -> DataFrame:
    """``(location_id_a, location_id_b)``, the smaller first, of all different locations that denote the same premises.

    Same box, or same number with its letter, unit (none is not the same as some), street with type and direction; and
    same town. Two addresses that share one face and contradict each other in the other do not match. Building names,
    postcode and state do not matter. Rows without a box and without number and street denote no premises and match
    nothing, nor does a row whose town or street type is neither given nor told by the postcode nor by the only place that fits,
    nor one with a null id. Nulls in other columns count as missing parts; repeated rows
    count once, extra columns are ignored, and an empty table gives an empty result. A place with any number of locations is
    paired in blocks.
    """
    stash = Stash(locations.sparkSession)
    places = stash.put(place_groups(locations, stash))
    pairs = pairs_within(places, "place", "location_id", ["other"])
    agree = F.col("other_a").isNull() | F.col("other_b").isNull() | (F.col("other_a") == F.col("other_b"))
    return pairs.where(agree).select("location_id_a", "location_id_b").distinct()


def place_members(locations: DataFrame) -> DataFrame:
    """``(location_id, kind, place)``: the place of each location by box and by street, as one row each; the smallest
    location_id of a place names it. The form of the result that stays as small as the table."""
    stash = Stash(locations.sparkSession)
    places = stash.put(place_groups(locations, stash).select("location_id", "kind", "place"))
    least = places.groupBy("place").agg(F.min("location_id").alias("first"))
    return salted_join(places, least, "place", how="inner").select("location_id", "kind", F.col("first").alias("place")).distinct()
