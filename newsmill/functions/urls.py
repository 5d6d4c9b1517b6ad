"""URL functions, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and names with a meaning.
REPO_HOSTS = ("github.com", "gitlab.com")
MODEL_HOSTS = ("huggingface.co", "hf.co")
PAPER_HOSTS = ("arxiv.org", "ar5iv.labs.arxiv.org")
POST_HOSTS = ("x.com", "twitter.com")
BLOG_WORDS = (
    "openai|anthropic|deepmind|google|meta|microsoft|nvidia|mistral|unsloth|"
    "databricks|cohere|stability|perplexity|vercel|modal|together|replicate|groq"
)
JUNK_HOSTS = ("news.smol.ai", "latent.space", "support.substack.com", "i.redd.it", "preview.redd.it")
JUNK_PARTS = ("twitter.com/i/lists/", "x.com/i/")
RESERVED_OWNERS = (
    "features", "login", "pricing", "about", "marketplace", "explore", "topics",
    "collections", "trending", "sponsors", "orgs", "apps", "contact", "security",
)
REPO_URL = r"https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
DISCUSSION = "https://news.ycombinator.com/item?id="

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def hostname(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def host_of(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def _one_of(c: Column, values) -> Column:
    return c.isin(*values)


def kind_from_url(url: Column) -> Column:
    h = host_of(url)
    return F.when(_one_of(h, REPO_HOSTS), "repo").when(_one_of(h, MODEL_HOSTS), "model").when(_one_of(h, PAPER_HOSTS), "paper")


def classify_host(h: Column) -> Column:
    """The class of a host; the first rule that fits decides."""
    blog = h.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{BLOG_WORDS})(?:$|[^\p{{L}}\p{{N}}_])") | h.endswith(".ai") | h.endswith(".dev") | h.contains("substack.com")
    return (
        F.when((h == "github.com") | h.endswith(".github.io"), "github")
        .when(_one_of(h, MODEL_HOSTS), "huggingface")
        .when(_one_of(h, PAPER_HOSTS), "arxiv")
        .when(blog, "blog")
        .when((h == "reddit.com") | h.endswith(".reddit.com"), "reddit")
        .when(_one_of(h, POST_HOSTS), "tweet")
    )


def is_junk(url: Column, h: Column) -> Column:
    out = (F.coalesce(url, F.lit("")) == "") | _one_of(h, JUNK_HOSTS)
    for p in JUNK_PARTS:
        out = out | url.contains(p)
    return out


def skip_domain(url: Column) -> Column:
    """Hosts whose pages aren't fetched: post hosts and what is below them; and addresses with a single bracket, which don't parse."""
    h = hostname(url)
    place = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    out = place.contains("[") != place.contains("]")
    for d in POST_HOSTS:
        out = out | (h == d) | h.endswith("." + d)
    return out


def repo_from_text(text: Column) -> Column:
    """The first repository URL of a text, null if its owner is a reserved name (a later one doesn't count then)."""
    owner = F.regexp_extract(text, REPO_URL, 1)
    whole = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), F.regexp_extract(text, REPO_URL, 2))
    return F.when((owner != "") & ~_one_of(F.lower(owner), RESERVED_OWNERS), whole)


def discussion_url(url: Column, item_id: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(DISCUSSION), item_id.cast("string")))


def strip_utm(url: Column) -> Column:
    """Without campaign parameters, and without the separator that they leave."""
    return F.regexp_replace(F.regexp_replace(url, r"([?&])utm_[^&#]*&?", "$1"), r"[?&]+(#|$)", "$1")


def resolve_kind(url: Column, model_kind: Column, content: Column) -> Column:
    """The URL's kind, else the model's; a blog post whose content has a repository is a repository."""
    kind = F.coalesce(kind_from_url(url), F.lower(model_kind))
    return F.when((kind == "blog") & repo_from_text(F.coalesce(content, F.lit(""))).isNotNull(), "repo").otherwise(kind)
