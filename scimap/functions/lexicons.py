"""Word lists and tables that operators take as defaults; every operator takes others as parameters."""

from __future__ import annotations

# Fixed values from here on: results are defined by them.

#: Keyword -> canonical keyword.
SYNONYMS = {
    "games": "game",
    "serious games": "serious game",
    "educational games": "educational game",
    "video games": "video game",
    "digital games": "digital game",
    "computer games": "computer game",
    "mobile games": "mobile game",
    "game engines": "game engine",
    "game based learning": "game-based learning",
    "gamebased learning": "game-based learning",
    "game-based-learning": "game-based learning",
    "games-based learning": "game-based learning",
    "games based learning": "game-based learning",
    "game-based learning (gbl)": "game-based learning",
    "digital game based learning": "digital game-based learning",
    "digital game-based learning (dgbl)": "digital game-based learning",
    "gamification of learning": "gamification",
    "gamified learning": "gamification",
    "virtual reality (vr)": "virtual reality",
    "augmented reality (ar)": "augmented reality",
    "mixed reality (mr)": "mixed reality",
    "extended reality (xr)": "extended reality",
    "artificial intelligence (ai)": "artificial intelligence",
    "generative artificial intelligence": "generative ai",
    "generative a.i.": "generative ai",
    "genai": "generative ai",
    "large language models": "large language model",
    "large language model (llm)": "large language model",
    "llms": "large language model",
    "video game development": "game development",
    "game develop": "game development",
    "games development": "game development",
    "game-development": "game development",
    "game design and development": "game development",
    "computer science education (cs education)": "computer science education",
    "cs education": "computer science education",
    "k-12 education": "k-12",
    "k12": "k-12",
    "stem education": "stem",
    "higher-education": "higher education",
    "e learning": "e-learning",
    "elearning": "e-learning",
    "unity3d": "unity",
    "unity 3d": "unity",
    "unity game engine": "unity",
    "unreal": "unreal engine",
    "unreal engine 4": "unreal engine",
    "unreal engine 5": "unreal engine",
}

#: Last words of keywords that end in s but are no plurals.
PROTECTED = [
    "graphics", "physics", "mathematics", "analytics", "robotics", "economics", "statistics", "aesthetics",
    "ethics", "logistics", "kinematics", "dynamics", "mechanics", "genetics", "informatics", "linguistics",
    "esports", "news", "series", "species", "means", "campus", "bias", "gas",
    "focus", "corpus", "status", "apparatus", "stimulus",
]

#: Characters stripped from both ends of a keyword.
KEYWORD_STRIP = "“”‘’\"'. "

COUNTRY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "united states of america": "United States",
    "united states": "United States",
    "uk": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "united kingdom": "United Kingdom",
    "south korea": "Korea, Republic of",
    "republic of korea": "Korea, Republic of",
    "korea": "Korea, Republic of",
    "czech republic": "Czechia",
    "russia": "Russian Federation",
    "viet nam": "Vietnam",
    "iran": "Iran, Islamic Republic of",
}

TERM_FAMILIES = {
    "mobile": ["mobile", "mobile game", "mobile development", "mobile learning", "android", "ios", "smartphone", "mobile application", "app development"],
    "generative_ai": ["generative ai", "large language model", "chatgpt", "gpt", "llm", "generative artificial intelligence", "diffusion model", "prompt engineering", "copilot", "genai"],
    "immersive_xr": ["virtual reality", "augmented reality", "mixed reality", "extended reality", "metaverse"],
    "ai_general": ["artificial intelligence", "machine learning", "deep learning", "neural network", "procedural content generation"],
}

#: Attribute -> terms, for attribute scores; the total is over the first table.
ADOPTION_ATTRIBUTES = {
    "relative_advantage": ["free", "open source", "open-source", "cross-platform", "cross platform", "multiplatform", "multi-platform", "performance", "powerful", "efficient", "real-time", "real time"],
    "compatibility": ["interoperable", "interoperability", "standard", "standards", "standardisation", "api", "plugin", "integration", "compatible", "pipeline", "workflow"],
    "low_complexity": ["easy", "tutorial", "tutorials", "beginner", "intuitive", "simple", "accessible", "documentation", "usability", "novice"],
    "trialability": ["trial", "demo", "demonstration", "sample", "example", "open source", "community", "free", "tutorial"],
    "observability": ["deployed", "released", "shipped", "showcase", "published", "production", "industry", "commercial", "professional"],
}
ACCEPTANCE_CONSTRUCTS = {
    "perceived_usefulness": ["productive", "efficient", "useful", "effective", "beneficial", "powerful", "professional", "industry"],
    "perceived_ease_of_use": ["easy", "intuitive", "accessible", "simple", "beginner", "novice", "tutorial"],
}

PLATFORMS = ["unity", "unreal", "unreal engine", "godot", "gamemaker", "construct", "roblox", "cocos2d"]
#: Platforms whose names are common words have patterns of their own.
PLATFORM_PATTERNS = {"construct": r"\bconstruct\s*(?:2|3|classic|engine|game\s+engine)\b|\bscirra\b"}

EDUCATION_TERMS = ["education", "teaching", "learning", "curriculum", "student", "course", "classroom", "pedagog", "instruction", "training", "school", "university", "undergraduate", "k-12", "learner", "competenc", "skill"]
GAME_TERMS = ["game development", "game design", "game programming", "game engine", "serious game", "game-based", "gamif", "video game", "game jam", "game creation", "developing games", "making games", "game-making"]

TOPIC_WORDS = ["unity", "юники", "юнити", "game", "игра", "игры", "гейм", "virtual reality", "виртуальная реальность", "vr", "вр", "augmented reality", "дополненная реальность", "ar", "ар", "education", "образование", "обучение", "serious game", "серьезные игры", "development", "разработка", "девелопмент", "gamification", "геймификация", "motivation", "мотивация", "3d", "три д", "трехмерный"]

#: Message categories: the first pattern that matches names the category.
CATEGORY_PATTERNS = [
    ("методик|метод|procedure|процедур", "Methodology"),
    ("рецепт|recipe|воспроизводим", "Reproducibility"),
    ("skopus|scopus|скопус|база", "Database Usage"),
    ("поиск|search|искать", "Search Strategy"),
    ("карта|map|сеть|network", "Network Analysis"),
    ("кластер|cluster|группа", "Clustering"),
    ("файл|file|сохран", "Documentation"),
]

#: Name, first year and last year; None is open.
ERAS = [("pre-2018", None, 2017), ("2018-2021", 2018, 2021), ("2022-2026", 2022, 2026)]

DOI_PATTERN = r"10\.\d{4,9}/[^\s,;]+"
YEAR_PATTERN = r"\((\d{4})\)"
