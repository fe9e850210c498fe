"""Configuration: post templates, bill feed catalog, ranking parameters.

The templates' fixed texts below must equal the reference's output format.
Footers and feed addresses are deployment configuration; the defaults are
neutral placeholders.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: post layout per community -------------------------------
# Positional arguments: 1 title, 2 blog_name, 3 url, 4 description, 5 footer.
LINKED_BODY = "[Read full post by %2$s](%3$s)\n\n-----\n\n%4$s\n\n-----\n \n%5$s"
POST_TEMPLATES = {
    "dnd": ("[Blog] %1$s", LINKED_BODY),
    "nfl": ("[%2$s] %1$s", LINKED_BODY),
    "politics": ("%1$s", "%3$s\n\n%4$s"),
    "science": ("%1$s", "%3$s"),
}
DEFAULT_TEMPLATE = ("%1$s", "%3$s")
DEFAULT_FOOTER = "Posted automatically; questions go to this community's maintainers."
SUMMARY_POST = "{summary}\n\n[Read more]({url})"

# ---- bill feeds -------------------------------------------------------------
BILL_SITE = "https://site.example.org"


@dataclass(frozen=True)
class FeedSpec:
    feed_url: str
    type: str
    file: str
    enabled: bool


# Three bill feeds; the Votes feed is switched off, as in the reference.
BILL_FEEDS = (
    FeedSpec("https://bills.example.org/events.rss?list=activity", "Activity", "feed_activity.xml", True),
    FeedSpec("https://bills.example.org/events.rss?list=votes", "Votes", "feed_votes.xml", False),
    FeedSpec("https://bills.example.org/events.rss?list=new", "New", "feed_new.xml", True),
)


# ---- ranking ----------------------------------------------------------------
# A frozen English stop list (common function words).  The reference's
# library list is longer; pass ``stop_words=`` to use another list.
STOP_WORDS = tuple("""
a about above after again against all also am an and any are as at be because
been before being below between both but by can could did do does doing down
during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me more most my myself
no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your yours
yourself yourselves
""".split())


@dataclass(frozen=True)
class RankParams:
    """TF-IDF sentence ranking parameters (uni- and bigrams, smooth idf, l2)."""
    num_points: int = 5
    min_df: int = 3
    max_df: float = 0.9
    stop_words: tuple = field(default=STOP_WORDS)
    score_digits: int = 9
    #: Longest article that is ranked in one task; longer ones are spread.  None: each in one task.
    task_chars: int | None = None


@dataclass(frozen=True)
class SummaryParams:
    chunk_size: int = 5
    max_sentences: int = 7
    # Passed to a summarizer hook: tokens of its input, and of its summary.
    max_input: int = 1024
    max_length: int = 150
    min_length: int = 50
