"""Words, domains, patterns and numbers that results depend on."""

from __future__ import annotations

# --- fixed values: topics in order of precedence, with their keywords; a keyword that is listed n times counts n times
TOPICS = ["tech", "finance", "science", "sports", "news", "education", "entertainment", "health", "general"]

TECH = [
    "python", "api", "code", "github", "library", "framework", "model", "llm", "ai", "machine learning", "deep learning",
    "neural network", "dataset", "training", "inference", "deployment", "docker", "cloud", "backend", "frontend", "devops",
    "compiler", "algorithm", "tutorial", "documentation", "opensource", "version control", "debugging", "performance",
    "scalability", "security", "vulnerability", "exploit", "patch", "update", "release", "benchmark", "evaluation", "research",
    "innovation", "startup", "funding", "investment", "acquisition", "merger", "layoff", "hiring", "job market", "remote work",
    "hybrid work", "office culture", "diversity", "inclusion",
]

FINANCE = [
    "gst", "tax", "income tax", "rate", "market", "stock", "equity", "shares", "ipo", "investment", "mutual fund", "sip", "rbi",
    "inflation", "interest rate", "banking", "budget", "fiscal policy", "revenue", "profit", "loss", "cryptocurrency", "bitcoin",
    "trading", "forex", "currency", "economy", "economic growth", "recession", "unemployment", "gdp", "fiscal stimulus",
    "monetary policy", "quantitative easing", "deficit", "debt", "credit", "rating", "dow jones", "s&p 500", "nasdaq", "sensex",
    "nifty", "bse", "nse", "commodity", "gold", "silver", "oil", "gas", "real estate", "housing market", "mortgage", "property",
    "realestate", "realestate market", "realestate development", "realestate investment", "realestate consultancy",
    "realestate broker", "realestate agent", "realestate broker",
]

SCIENCE = [
    "research", "study", "paper", "experiment", "physics", "chemistry", "biology", "mathematics", "theorem", "equation",
    "data analysis", "simulation", "astronomy", "genetics", "neuroscience", "lab", "hypothesis", "scientific method", "discovery",
    "innovation", "nobel", "award", "conference", "publication", "peer review", "replication", "open science",
    "science communication", "climate change", "environment", "sustainability", "energy", "renewable energy", "fossil fuels",
    "carbon emissions", "biodiversity", "conservation", "space exploration", "space mission", "mars", "moon", "satellite",
    "telescope", "quantum mechanics", "relativity", "string theory", "dark matter", "dark energy", "multiverse", "cosmology",
    "particle physics", "higgs boson", "gravitational waves", "black hole", "wormhole", "time travel", "parallel universe",
    "extraterrestrial life", "astrobiology", "exoplanet", "space colonization", "artificial intelligence", "machine learning",
    "deep learning", "neural network", "neural network", "neural network", "neural network", "neural network", "neural network",
]

SPORTS = [
    "cricket", "football", "soccer", "basketball", "tennis", "badminton", "olympics", "tournament", "match", "score", "result",
    "league", "ipl", "world cup", "fifa", "f1", "gp", "formula 1", "driver", "team", "standings", "highlights", "wins", "race",
    "winner", "record", "podium", "championship", "champion", "athlete", "player", "coach", "manager", "referee", "grand prix",
    "qualifying", "pit stop", "overtake", "safety car", "penalty", "yellow flag", "red flag", "lap time", "fastest lap",
    "pole position", "driver of the day", "constructor", "engine", "aerodynamics", "tire strategy", "weather conditions",
]

NEWS = [
    "breaking", "headline", "report", "update", "government", "policy", "election", "minister", "parliament", "law", "court",
    "verdict", "international", "geopolitics", "conflict", "economy news", "regulation", "scandal", "investigation", "protest",
    "diplomacy", "summit", "treaty", "sanction", "aid", "humanitarian", "refugee", "climate change", "environment", "disaster",
    "corruption", "whistleblower",
]

EDUCATION = [
    "exam", "syllabus", "cbse", "icse", "jee", "neet", "university", "admission", "course", "lecture", "notes", "assignment",
    "result", "scholarship", "coaching", "preparation", "study material", "tutor", "online learning", "edtech", "curriculum",
    "grading", "academic", "research", "publication", "conference", "workshop", "seminar",
]

ENTERTAINMENT = [
    "movie", "film", "trailer", "actor", "actress", "music", "song", "album", "series", "netflix", "bollywood", "hollywood",
    "celebrity", "review", "box office", "release", "trailer", "song", "lyrics", "songwriter", "composer", "lyricist", "musician",
    "music video", "pop music", "rock music", "hip hop music", "electronic music", "classical music", "jazz music",
    "country music", "reggae music", "blues music", "folk music", "world music", "indie music", "soul music",
]

HEALTH = [
    "disease", "symptoms", "treatment", "medicine", "hospital", "doctor", "fitness", "diet", "nutrition", "mental health",
    "exercise", "vaccine", "diagnosis", "healthcare", "wellness", "public health", "epidemic", "pandemic", "virus", "bacteria",
    "immunity", "health policy", "health insurance", "medical research", "clinical trial", "pharmaceutical", "side effect",
    "health guideline",
]

GENERAL = [
    "news", "sports", "finance", "tech", "science", "health",
]

# --- fixed values: words that are never terms of a query
STOP_WORDS = [
    "the", "and", "for", "with", "this", "that", "from", "into", "about", "what", "when", "where", "which", "how", "why", "who",
    "are", "was", "were", "has", "have", "had", "will", "would", "could", "should", "can", "may", "might", "shall", "been",
    "being", "its", "than", "then", "they", "their", "them", "these", "those", "such", "also", "but", "not", "yet", "nor", "any",
    "all", "each", "both", "more", "most", "other", "some", "same", "just", "like", "very", "too",
]

# --- fixed values: domains that are never fetched
BLOCKED_DOMAINS = [
    "indianexpress.com", "hindustantimes.com", "ndtv.com", "timesofindia.indiatimes.com", "bloomberg.com", "wsj.com", "ft.com",
    "nytimes.com", "theatlantic.com", "udemy.com", "levelup.gitconnected.com", "datacamp.com", "youtube.com", "youtu.be",
    "pinterest.com", "goodreturns.in", "betterexplained.com", "suzukacircuit.jp", "motorsporttickets.com", "f1experiences.com",
    "plainenglish.io", "pub.towardsai.net", "towardsai.net", "informalnewz.com", "formulaonehistory.com", "bestcalendarprintable",
    "motorbiscuit.com", "f1dailybrief.com", "gpfans.com", "f1-fansite.com", "motorsportstats.com", "total-motorsport.com",
]

# --- fixed values: domains that get a boost while nothing is known of them
PRIORITY_DOMAINS = [
    "docs.python.org", "fastapi.tiangolo.com", "realpython.com", "docs.lancedb.com", "arxiv.org", "stackoverflow.com",
    "britannica.com", "wikipedia.com", "sciencedirect.com", "nature.com", "ncbi.nlm.nih.gov", "incometax.gov.in", "gst.gov.in",
    "mospi.gov.in", "rbi.org.in", "pib.gov.in", "developers.google.com", "developer.mozilla.org", "huggingface.co", "pytorch.org",
    "tensorflow.org", "khanacademy.org", "mit.edu", "nptel.ac.in", "formula1.com", "espncricinfo.com", "cricbuzz.com",
    "cricapi.com", "en.wikipedia.org", "github.com", "docs.microsoft.com", "learn.microsoft.com", "kubernetes.io", "react.dev",
    "nodejs.org", "go.dev", "rust-lang.org", "aws.amazon.com", "cloud.google.com", "pubmed.ncbi.nlm.nih.gov", "science.org",
    "ieee.org", "semanticscholar.org", "ocw.mit.edu", "coursera.org", "edx.org", "stanford.edu", "indiankanoon.org", "who.int",
    "cdc.gov", "investopedia.com", "reuters.com", "economist.com", "worldbank.org", "imf.org", "hbr.org", "mckinsey.com",
    "archive.org", "mayoclinic.org", "nasa.gov",
]

# --- fixed values: site hints by topic, in order
SITE_HINTS = {
    "tech": ["site:docs.python.org", "site:stackoverflow.com", "site:github.com"],
    "finance": ["site:rbi.org.in", "site:gst.gov.in", "site:incometax.gov.in"],
    "science": ["site:arxiv.org", "site:ncbi.nlm.nih.gov", "site:nature.com"],
    "health": ["site:ncbi.nlm.nih.gov", "site:who.int"],
    "education": ["site:nptel.ac.in", "site:mit.edu"],
}

# --- fixed values: rephrasings, of which the first that applies is taken
REPHRASE = [
    ("tutorial", "guide"), ("guide", "tutorial"), ("how to", "how do I"), ("error", "issue fix"), ("fix", "solution"),
    ("rate", "percentage"), ("law", "regulation"), ("price", "cost"), ("best", "top"), ("latest", "recent"),
    ("vs", "compared to"), ("explain", "what is"), ("what is", "explain"), ("overview", "introduction"),
]

# --- fixed values: topics whose vocabulary is borrowed when a query is ambiguous
ADJACENT = {"finance": "news", "news": "finance", "science": "tech", "tech": "science", "health": "science", "sports": "news", "education": "tech"}

# --- fixed values: patterns of sentences that are no content (start of the sentence), and of pages that are (anywhere)
SENTENCE_NOISE = [
    r"(switch language|cookie policy|accept cookies|privacy policy)",
    r"(all rights reserved|copyright ©)",
    r"(share this|follow us|subscribe)",
    r"(advertisement|sponsored|related articles)",
    r"\s*[\|\-—]{3,}\s*$",
    r"\s*\d+\s*$",
    r"(home|about|contact|login|sign up|sign in)\s*$",
]
PAGE_NOISE = [
    "cookie", "javascript", "enable javascript", "switch language", "all rights reserved", "subscribe now", "sign up", "log in",
    "advertisement", "sponsored", "click here", "privacy policy", "terms of service", "404", "page not found",
]
TAILS = [
    r"(share this|follow us|subscribe|click here).*",
    r"(advertisement|sponsored content).*",
    r"(all rights reserved|copyright ©).*",
    r"(related articles?|see also|read more).*",
    r"\s{3,}",
]
INJECTION_JUNK = ["cookie", "javascript", "switch language"]

# --- fixed values: weight of recency by topic, signs of topics
RECENCY_WEIGHT = {"news": 0.65, "sports": 0.60, "finance": 0.55, "entertainment": 0.50, "health": 0.45, "general": 0.40, "tech": 0.30, "science": 0.25, "education": 0.20}
BADGES = {"tech": "⚙", "finance": "₹", "sports": "🏁", "science": "🔬", "news": "📰", "education": "📚", "entertainment": "🎬", "health": "🏥", "general": "◆"}
YEAR_TOPICS = ["finance", "news", "sports", "tech", "health"]


def keywords() -> list[tuple[str, int, str, int]]:
    """(topic, rank, keyword, how often it is listed)."""
    found = []
    for rank, (topic, listed) in enumerate(zip(TOPICS, (TECH, FINANCE, SCIENCE, SPORTS, NEWS, EDUCATION, ENTERTAINMENT, HEALTH, GENERAL), strict=True)):
        found += [(topic, rank, w, listed.count(w)) for w in dict.fromkeys(listed)]
    return found
