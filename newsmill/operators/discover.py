"""Discovery steps: verdicts on profiles, links and products out of pages, and the choice among a product's candidate links.

Each model step is a function of columns, so a model's answer (an array column) can stand where the rule does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ledger
from ..functions import markup, urls
from . import state

NOTABLE_LENGTH = 20


def with_verdicts(profiles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Profiles with the verdict that a model echoed under their handle; the last verdict (``pos``) of a handle, null where there is none."""
    last = state.last_wins(verdicts, "handle", "pos").select("handle", "verdict")
    return profiles.join(last, "handle", "left")


def links(html: Column) -> Column:
    """url (without campaign parameters), class (null: none), text of a page's links in order."""
    clean = lambda x: urls.strip_utm(x["url"])
    return F.transform(markup.collect_links(html), lambda x: F.struct(clean(x).alias("url"), urls.classify_host(x["host"]).alias("class"), x["text"].alias("text")))


def products(html: Column) -> Column:
    """name and description by list entry: the bold text, or the first word where there is none, and the entry's whole text."""

    def product(body: Column) -> Column:
        whole, bold = markup.strip_tags(body), markup.first_bold(body)
        return F.struct(F.when(bold != "", bold).otherwise(F.substring_index(whole, " ", 1)).alias("name"), whole.alias("description"))

    return F.transform(F.regexp_extract_all(html, F.lit(markup.ENTRY), F.lit(1)), product)


def notable(found: Column) -> Column:
    """Numbers, from 1, of the products worth keeping: the stand-in keeps those that say something."""
    numbered = F.transform(found, lambda p, i: F.when(F.length(p["description"]) >= NOTABLE_LENGTH, i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def kept(found: Column, numbers: Column) -> Column:
    """The products with one of ``numbers`` (from 1); numbers out of range are ignored."""
    return F.filter(F.transform(found, lambda p, i: F.when(F.array_contains(numbers, i + 1), p)), lambda p: p.isNotNull())


def choose(name: Column, candidates: Column) -> Column:
    """The number, from 1, of the first candidate whose text or address has the name; 0 if there is none."""
    low = F.lower(name)
    fits = F.transform(candidates, lambda c: F.contains(F.lower(c["text"]), low) | F.contains(F.lower(c["url"]), low))
    return F.coalesce(F.array_position(fits, True), F.lit(0)).cast("int")


def chosen(candidates: Column, number: Column) -> Column:
    """The candidate at a number from 1; null for 0 and for numbers out of range."""
    return F.try_element_at(candidates, F.nullif(number, F.lit(0)))


def confidence(name: Column, candidate: Column) -> Column:
    """How sure the rule is of its choice: 0.9 if the candidate's host has the name, 0.5 for another place of it, 0 for no candidate."""
    squeezed = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    own = (squeezed != "") & F.contains(F.coalesce(urls.host_of(candidate["url"]), F.lit("")), squeezed)
    return F.when(candidate.isNull(), 0.0).when(own, 0.9).otherwise(0.5)


# --- model steps -------------------------------------------------------------------------------------
# Each takes rows with an unguessable number of model calls, so each takes a ledger (``book``) and its options.


def classified(profiles: DataFrame, model, book: ledger.Ledger | None = None, chunk: int = 20, **options) -> DataFrame:
    """``profiles`` (handle, name, description) with related and confidence (0 to 100), which the model echoed under the handle; nulls where it said
    nothing, and the last where it said more."""
    asked = profiles.select("handle", "name", "description").where("handle is not null").dropDuplicates(["handle"])
    got = ledger.asked(asked, model.classify_profiles, "handle string, related boolean, confidence int", chunk, "raise", book, "profiles", "handle", **options)
    got = got.groupBy("handle").agg(F.last(F.struct("related", "confidence")).alias("v")).select("handle", "v.related", F.when(F.col("v.confidence").isNotNull(), F.least(F.greatest("v.confidence", F.lit(0)), F.lit(100))).alias("confidence"))
    return profiles.join(got, "handle", "left")


def relevant(classified_: DataFrame, least: int = 50) -> DataFrame:
    """Profiles that the crawl goes on from: related with a confidence of ``least`` or more."""
    return classified_.where(F.col("related") & (F.col("confidence") >= least))


def links_by_model(pages: DataFrame, model, book: ledger.Ledger | None = None, **options) -> DataFrame:
    """(id, links) of (id, html): url (without campaign parameters), class and text of the links that the model names; none where it fails."""
    given = "id long, links array<struct<url:string,text:string>>"
    got = ledger.asked(pages.select("id", "html"), model.extract_links, given, 1, "keep", book, "links", "id", **options).select("id", F.col("links").alias("_l"))
    made = F.transform("_l", lambda x: F.struct(urls.strip_utm(x["url"]).alias("url"), urls.classify_host(urls.host_of(x["url"])).alias("class"), x["text"].alias("text")))
    none = F.array().cast("array<struct<url:string,class:string,text:string>>")
    return pages.join(got, "id", "left").withColumn("links", F.coalesce(made, none)).drop("_l")


def products_by_model(pages: DataFrame, model, book: ledger.Ledger | None = None, **options) -> DataFrame:
    """(id, products, kept) of (id, text): what the model finds, and of it what a second call says is notable; none where a call fails."""
    kind = "array<struct<name:string,description:string>>"
    found = ledger.asked(pages.select("id", "text"), model.extract_products, f"id long, products {kind}", 1, "keep", book, "products", "id", **options)
    none = F.array().cast(kind)
    rows = pages.join(found.select("id", "products"), "id", "left").withColumn("products", F.coalesce("products", none))
    worth = ledger.asked(rows.where(F.size("products") > 0).select("id", "products"), model.select_products, "id long, numbers array<int>", 1, "keep", book, "notable", "id", **options)
    rows = rows.join(worth.select("id", "numbers"), "id", "left")
    return rows.withColumn("kept", F.coalesce(kept(F.col("products"), F.col("numbers")), none)).drop("numbers")


def link_by_model(rows: DataFrame, model, book: ledger.Ledger | None = None, least: float = 0.0, **options) -> DataFrame:
    """``rows`` (id, name, description, candidates) with number, confidence (0 to 1) and url of the candidate that the model chose; number 0 and a null url
    for none, for a number out of range, a confidence below ``least`` and a failed call."""
    given = rows.select("id", "name", "description", "candidates")
    got = ledger.asked(given, model.select_link, "id long, number int, confidence double", 1, "keep", book, "link", "id", **options).select("id", F.col("number").alias("_n"), F.col("confidence").alias("_c"))
    out = rows.join(got, "id", "left")
    sure = F.least(F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    fits = F.col("_n").between(1, F.size("candidates")) & (sure >= least)
    out = out.withColumns({"number": F.when(fits, F.col("_n")).otherwise(0), "confidence": F.when(fits, sure).otherwise(0.0)})
    return out.withColumn("url", chosen(F.col("candidates"), F.col("number"))["url"]).drop("_n", "_c")
