"""Word lists, thresholds, windows and weights, by profile. Operators take them as parameters."""

from __future__ import annotations

# Lexicon and rules of the "lexicon" sentiment profile.
LEXICON = {
    "bullish": ["moon", "breakout", "accumulation", "buy wall", "whale buying"],
    "bearish": ["dump", "rug", "hack", "exploit", "sell wall"],
    "fear": ["panic", "exit", "collapse", "bankruptcy"],
    "greed": ["100x", "lambo", "all in", "yolo"],
}
RULES = {
    "bearish": [r"\b(?:dump|dumping|dumped)\b", r"\b(?:rug|rugpull)\b"],
    "greed": [r"\b\d{2,4}x\b"],
}
# Weights of the lexicon's categories, and the label's threshold.
COEFFICIENTS = {"bullish": 1.0, "greed": 0.5, "bearish": -1.2, "fear": -1.5}
LABEL_AT = 0.2

# Word sets of the "tokens" profile.
TOKENS = {
    "bullish": ["moon", "bullish", "buy", "long", "pump", "rocket", "ath", "breakout", "lambo", "hodl", "diamond", "gains", "surge", "rally", "parabolic", "explosive", "skyrocket", "mooning", "bull", "up", "green"],
    "bearish": ["crash", "bearish", "sell", "short", "dump", "rekt", "bear", "dip", "collapse", "plunge", "tank", "correction", "downfall", "panic", "fear", "capitulation", "bloodbath", "red", "down", "loss"],
    "fear": ["fear", "panic", "scared", "worried", "concern", "risk", "warning", "danger", "crash", "collapse", "uncertainty"],
    "greed": ["greed", "fomo", "yolo", "all-in", "100x", "rich", "millionaire", "lambo", "moon", "guaranteed", "easy money"],
}
# Terms of the "substring" profile.
SUBSTRINGS = {
    "bullish": ["bullish", "buy", "long", "moon", "pump", "breakout", "accumulation", "bullrun", "gains", "profit", "hodl", "adoption", "approved", "etf", "institutional", "golden cross", "support", "breaking out", "target", "life-changing", "future", "rising", "accelerating"],
    "bearish": ["bearish", "sell", "short", "crash", "dump", "breakdown", "distribution", "loss", "fear", "panic", "correction", "pullback", "overbought", "careful", "warning", "bleeding", "sold", "overheated", "pressure"],
}
# Terms of the "context" profile.
CONTEXT_TERMS = {
    "bullish": ["bullish", "moon", "pump", "buy", "long", "breakout", "🚀", "📈"],
    "bearish": ["bearish", "dump", "sell", "short", "crash", "drop", "📉"],
}
# Terms of the manipulation flag.
PUMP_TERMS = ["pump", "guaranteed", "100x", "1000x", "insider", "secret"]

# Reliabilities and time rules by source, in seconds.
RELIABILITY = {"twitter": 0.5, "reddit": 0.7, "telegram": 0.3}
DEFAULT_RELIABILITY = 0.5
MAX_DELAY = {"twitter": 15, "reddit": 120, "telegram": 30}
ORDER_TOLERANCE = {"twitter": 5, "reddit": 60, "telegram": 10}
DUPLICATE_WINDOW = {"twitter": 300, "reddit": 1800, "telegram": 600}
AVAILABILITY_DEGRADED = {"twitter": 60, "reddit": 900, "telegram": 120}
AVAILABILITY_DOWN = {"twitter": 300, "reddit": 3600, "telegram": 600}

# Hours of silence by channel type.
ACTIVITY_HOURS = {"news": 24, "analytics": 24, "aggregator": 24, "whale": 12, "liquidation": 12, "price": 12, "community": 48, "education": 24}
DEFAULT_ACTIVITY_HOURS = 24
MAX_ERRORS = 3

# The asset catalog (symbol, name, keywords, priority).
ASSETS = [
    ("BTC", "Bitcoin", ["btc", "bitcoin", "satoshi", "sats"], 10),
    ("ETH", "Ethereum", ["eth", "ethereum", "ether"], 9),
    ("SOL", "Solana", ["sol", "solana"], 8),
    ("XRP", "Ripple", ["xrp", "ripple"], 7),
    ("BNB", "Binance Coin", ["bnb", "binance coin"], 7),
    ("ADA", "Cardano", ["ada", "cardano"], 6),
    ("DOGE", "Dogecoin", ["doge", "dogecoin"], 6),
    ("TRX", "Tron", ["trx", "tron"], 5),
    ("USDT", "Tether", ["usdt", "tether"], 4),
    ("USDC", "USD Coin", ["usdc", "usd coin"], 4),
]

# Velocity profiles: short and long window in seconds, divisor of the long count, whether the lower end is open,
# digits (None: as is), and the value where the long rate is 0.
VELOCITY = {
    "crawl_tw": {"short": 60, "long": 3600, "open": False, "digits": None, "default": 1.0},
    "ing_tw": {"short": 60, "long": 300, "open": True, "digits": 2, "default": 0.0},
    "ing_rd": {"short": 300, "long": 1800, "open": True, "digits": 2, "default": 0.0},
    "ing_tg": {"short": 60, "long": 300, "open": True, "digits": 2, "default": 0.0},
}
# As-of velocity: short and long window in seconds; the long count is divided by long / short.
VELOCITY_ASOF = {"crawl_rd": (6 * 3600, 48 * 3600), "crawl_tg": (600, 3600)}
