"""Fixed values of the domain: tags, keyword dictionaries, weights and thresholds.

They decide results, so they are stated plainly; nothing else in the library repeats them.
"""

from __future__ import annotations

# Tag domains, in tie-break order where one is used.
PLATFORMS = ("twitter", "facebook", "reddit", "qiita", "github", "instagram", "alerts")
PRIMARY_ORDER = ("SECURITY", "REGULATION", "MCP_API", "AGENT", "RESEARCH", "UPDATE", "TECH", "DEVICE", "BUSINESS", "COLUMN", "OTHER")
ACTION_ORDER = ("APPLY", "EVAL", "WATCH", "INFO")
SUB_BY_PRIMARY = {
    "UPDATE": ("NEW_LLM", "LLM_UPDATE", "OSS_FW"),
    "AGENT": ("AGENT_DEV", "AGENT_OPS", "MULTI_AGENT"),
    "TECH": ("PROMPT", "CTX_ENG", "RAG_SEARCH"),
    "RESEARCH": ("PAPER", "BENCH"),
    "MCP_API": ("MCP", "SDK_API"),
    "DEVICE": ("WEARABLE", "ROBOTICS_HW"),
}

# Words that put an item within the AI domain.
AI_KEYWORDS = (
    "ai", "llm", "gpt", "claude", "gemini", "model", "inference", "machine learning", "ml", "neural", "transformer", "mcp", "prompt", "rag", "agent", "agents",
    "openai", "anthropic", "deepseek", "chatgpt", "生成ai", "生成 ai", "エージェント", "機械学習", "人工知能", "大規模言語", "論文", "ベンチマーク",
)

# Words of each primary tag.
PRIMARY_KEYWORDS = {
    "UPDATE": ("release", "launched", "launch", "shipping", "changelog", "update", "updated", "new model", "new version", "preview", "一般提供", "新機能", "アップデート", "公開"),
    "MCP_API": ("mcp", "model context protocol", "mcp server", "mcp client", "api", "sdk", "endpoint", "webhook", "integration", "connector", "client library", "rest", "graphql", "tool calling", "連携", "api連携"),
    "AGENT": ("agent", "agents", "ai agent", "autonomous agent", "agentic", "agent framework", "agent sdk", "agent workflow", "orchestration", "multi-agent", "a2a", "operator", "エージェント", "マルチエージェント", "自律エージェント", "オーケストレーション"),
    "TECH": ("prompt", "rag", "retrieval", "embedding", "search pipeline", "fine-tuning", "finetuning", "context engineering", "implementation", "実装", "検証", "手法", "プロンプト", "検索", "埋め込み", "コンテキスト"),
    "RESEARCH": ("paper", "arxiv", "preprint", "benchmark", "leaderboard", "sota", "state of the art", "eval", "evaluation", "dataset", "method", "research", "論文", "研究", "ベンチマーク", "評価", "リーダーボード"),
    "DEVICE": ("hardware", "chip", "gpu", "npu", "device", "wearable", "glasses", "robot", "robotics", "embedded", "edge ai", "デバイス", "ウェアラブル", "半導体"),
    "SECURITY": ("security", "vulnerability", "cve", "prompt injection", "jailbreak", "exploit", "data leak", "breach", "リスク", "脆弱性", "セキュリティ"),
    "REGULATION": ("regulation", "policy", "compliance", "governance", "government", "law", "legal", "eu ai act", "条例", "規制", "政策", "法案", "ガバナンス"),
    "BUSINESS": ("funding", "raised", "raises", "acquisition", "acquired", "merger", "partnership", "revenue", "enterprise", "valuation", "資金調達", "提携", "買収", "事業"),
    "COLUMN": ("opinion", "hot take", "meme", "humor", "funny", "satire", "culture", "コラム", "雑談", "ネタ"),
    "OTHER": (),
}

# Words of each sub tag.
SUB_KEYWORDS = {
    "NEW_LLM": ("new model", "new llm", "foundation model", "general availability", "announce", "発表", "新モデル"),
    "LLM_UPDATE": ("model update", "improved", "upgrade", "faster", "context window", "pricing", "性能向上", "改善"),
    "OSS_FW": ("open source", "oss", "framework", "library", "sdk", "github", "repo", "パッケージ"),
    "AGENT_DEV": ("agent framework", "agent sdk", "agent library", "agent builder", "tool use", "function calling", "agent 開発", "エージェント開発", "フレームワーク"),
    "AGENT_OPS": ("agent ops", "production agent", "agent workflow", "reliability", "cost", "monitoring", "evals in production", "運用", "本番", "信頼性", "コスト"),
    "MULTI_AGENT": ("multi-agent", "multi agent", "a2a", "agent-to-agent", "orchestration", "swarm", "マルチエージェント", "複数エージェント", "オーケストレーション"),
    "PROMPT": ("prompt", "system prompt", "jailbreak prompt", "instruction", "プロンプト"),
    "CTX_ENG": ("context", "memory", "context engineering", "long context", "コンテキスト", "メモリ"),
    "RAG_SEARCH": ("rag", "retrieval", "embedding", "vector search", "search pipeline", "hybrid search", "検索", "埋め込み", "ベクトル検索"),
    "PAPER": ("paper", "arxiv", "preprint", "method", "research", "論文", "研究", "手法"),
    "BENCH": ("benchmark", "leaderboard", "sota", "evaluation", "eval", "ベンチマーク", "評価", "リーダーボード"),
    "MCP": ("mcp", "model context protocol", "mcp server", "mcp client", "mcpサーバー"),
    "SDK_API": ("api", "sdk", "endpoint", "webhook", "connector", "client library", "api連携", "連携"),
    "WEARABLE": ("wearable", "smart glasses", "headset", "ring", "watch", "ウェアラブル"),
    "ROBOTICS_HW": ("robot", "robotics", "drone", "chip", "gpu", "hardware", "ロボット", "ハードウェア"),
}

# Words of each action tag.
ACTION_KEYWORDS = {
    "APPLY": ("how to", "tutorial", "guide", "implementation", "sample code", "example", "repo", "quickstart", "hands-on", "導入", "実装", "手順"),
    "EVAL": ("benchmark", "compare", "comparison", "vs", "evaluation", "latency", "accuracy", "ab test", "検証", "比較", "評価"),
    "WATCH": ("preview", "roadmap", "rumor", "teaser", "coming soon", "waitlist", "beta", "予定", "今後", "様子見"),
    "INFO": (),
}

# What single platforms add.
PRIMARY_BOOSTS = {
    "twitter": {"UPDATE": ("ship", "shipped", "drop", "thread"), "COLUMN": ("hot take", "my take")},
    "github": {"UPDATE": ("release notes", "tag", "v1.", "v2.", "v3."), "TECH": ("pull request", "commit", "issue", "diff")},
    "qiita": {"TECH": ("手順", "実装", "ハンズオン", "解説")},
    "reddit": {"TECH": ("discussion", "show hn", "ama")},
}
ACTION_BOOSTS = {"github": {"APPLY": ("readme", "quick start", "install")}}
LOW_INFO_MIN_CHARS = {"twitter": 32, "github": 24, "qiita": 50, "reddit": 40}
DEFAULT_LOW_INFO_MIN_CHARS = 36
TWITTER_NOISE = r"^(rt\s+@|@[a-z0-9_]+\s*$)"
STALE_DAYS = 31

# Headline and detail scoring.
HEADLINE_PRIMARY = {"SECURITY": 24, "REGULATION": 20, "MCP_API": 18, "AGENT": 17, "UPDATE": 16, "TECH": 14, "RESEARCH": 12, "DEVICE": 10, "BUSINESS": 8, "COLUMN": 6, "OTHER": 4}
HEADLINE_ACTION = {"APPLY": 8, "EVAL": 6, "WATCH": 4, "INFO": 2}
DETAIL_PLATFORM = {"alerts": 30, "qiita": 24, "github": 22, "reddit": 14, "facebook": 12, "instagram": 8, "twitter": 6}
MAX_HEADLINES, MIN_HEADLINE_SCORE = 5, 35
DUP_MATCH_SCORES = (("direct_binding", 1.0), ("canonical_url_match", 0.96), ("url_match", 0.92), ("title_exact_match", 0.82))
TITLE_JACCARD, COSINE_THRESHOLD, CLUSTER_GAMMA = 0.82, 0.84, 0.5

# Sections of an edition.
SECTION_OF = {
    "UPDATE": "2_update", "AGENT": "2b_agent", "MCP_API": "3_mcp_api", "TECH": "4_tech", "RESEARCH": "4b_research", "DEVICE": "5_device",
    "SECURITY": "6_security", "REGULATION": "7_regulation", "BUSINESS": "8_business", "OTHER": "9_other", "COLUMN": "10_column",
}
SUBSECTION_OF = {
    "NEW_LLM": "2-1_new_llm", "LLM_UPDATE": "2-2_llm_update", "OSS_FW": "2-3_oss_fw", "AGENT_DEV": "2b-1_agent_dev", "AGENT_OPS": "2b-2_agent_ops",
    "MULTI_AGENT": "2b-3_multi_agent", "AGENT": "4-1_agent", "PROMPT": "4-2_prompt", "CTX_ENG": "4-3_context_engineering", "RAG_SEARCH": "4-4_rag_search",
    "PAPER": "4b-1_paper", "BENCH": "4b-2_bench", "MCP": "3-1_mcp", "SDK_API": "3-2_sdk_api", "PAPER_BENCH": "4-4_paper_bench", "WEARABLE": "5-1_wearable", "ROBOTICS_HW": "5-2_robotics_hw",
}
HEADLINE_SECTION = "1_latest_ai_news"
SECTION_TITLES = {
    "1_latest_ai_news": "最新AIニュース", "2_update": "アップデート情報", "2b_agent": "エージェント動向", "3_mcp_api": "MCPサーバー・API情報", "4_tech": "技術速報", "4b_research": "リサーチ・論文",
    "5_device": "AIデバイス情報", "6_security": "セキュリティリスク", "7_regulation": "規制・政策・ガバナンス", "8_business": "ビジネス・資金調達", "9_other": "その他注目の内容", "10_column": "AIおもしろコラム", "11_market_voice": "市場の声・実ユーザー評価",
}
# Articles of a section, elsewhere SECTION_LIMIT.
SECTION_LIMITS = {
    "1_latest_ai_news": 8, "2_update": 10, "3_mcp_api": 8, "4_tech": 12, "5_device": 6, "6_security": 8, "7_regulation": 6, "8_business": 8, "9_other": 5, "10_column": 6,
}
SELECTION_LIMIT, MAIN_LIMIT, RESCUE_LIMIT, SECTION_LIMIT = 120, 2000, 500, 8
#: Candidates that make a section dense, and articles that it then has to print.
DENSE_ITEMS = 3
FALLBACK_HASH_PREFIX = "llm_error_fallback::"

# Parameters that alert links lose when they are collected, and when their pages are fetched.
ALERT_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
FETCH_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")

# Trust.
TRUST_MULTIPLIERS = {"high": 1.08, "medium": 1.0, "unknown": 0.95, "low": 0.8}
TRUST_WEIGHTS = {"item_quality": 0.45, "selection": 0.25, "prior": 0.15, "freshness": 0.05}
MIN_CLASSIFIED, PRIOR_DECAY_ITEMS = 15, 50

# Voices.
VOICE_MODEL = "rule-based:v1"
SOCIAL_PLATFORMS = ("twitter", "facebook", "reddit", "instagram")
POSITIVE = (
    "great", "good", "love", "amazing", "awesome", "excellent", "impressive", "useful", "helpful", "fast", "faster", "stable", "smooth", "best", "solid", "works",
    "神", "最高", "便利", "助かる", "速い", "良い", "使える", "コスパ", "推せる", "改善",
)
NEGATIVE = (
    "bad", "worse", "worst", "slow", "broken", "bug", "bugs", "issue", "error", "fail", "failing", "hate", "disappoint", "expensive", "overpriced", "unusable", "crash",
    "脆弱", "最悪", "遅い", "高い", "重い", "微妙", "使えない", "バグ", "不安定",
)
USAGE_CONTEXTS = {
    "coding": ("code", "coding", "dev", "developer", "programming", "repo", "github", "pr", "pull request", "api", "sdk", "cli", "debug", "implementation", "実装", "開発", "コード", "デバッグ"),
    "ideation": ("idea", "ideation", "brainstorm", "creative", "concept", "design", "strategy", "planning", "企画", "発想", "アイデア", "壁打ち"),
    "speed": ("fast", "faster", "speed", "latency", "quick", "realtime", "response time", "throughput", "高速", "速い", "遅い", "性能"),
    "cost": ("cost", "price", "pricing", "cheap", "expensive", "token", "budget", "subscription", "credit", "料金", "コスト", "高い", "安い", "課金"),
    "automation": ("agent", "workflow", "automation", "tool use", "mcp", "integration", "orchestration", "自動化", "連携", "運用"),
    "quality": ("quality", "accuracy", "hallucination", "reliable", "trust", "precision", "benchmark", "品質", "精度", "信頼", "幻覚"),
}
TOPIC_FALLBACK = {
    "UPDATE": "AI Update", "MCP_API": "MCP/API", "TECH": "AI Engineering", "DEVICE": "AI Device", "SECURITY": "AI Security", "REGULATION": "AI Policy",
    "BUSINESS": "AI Business", "COLUMN": "AI Commentary", "OTHER": "AI General",
}
TOPIC_GPT = r"gpt[-\s]?\d+(?:\.\d+)?(?:\s*(?:mini|nano|pro|high|turbo|o\d))?"
TOPIC_LLAMA, TOPIC_REST = r"llama(?:\s*\d+(?:\.\d+)?)?(?:\s+[a-z0-9.-]+)?", r"(?:\s+[a-z0-9.-]+){0,2}"
TOPIC_FAMILIES = ("claude", "gemini", "deepseek", "qwen")
TOPIC_NAMES = (("cursor", "Cursor"), ("copilot", "GitHub Copilot"), ("openrouter", "OpenRouter"), ("model context protocol|mcp", "MCP / API"), ("openai", "OpenAI"), ("anthropic", "Anthropic"))

# Lifecycle, discovery and retention.
MIN_SOURCE_AGE_DAYS, MIN_CLASSIFIED_28D, COOLDOWN_DAYS = 14, 20, 30
NOISE_DELTA, MIN_NOISE, SEVERE_NOISE, LOW_TRUST = 0.15, 0.35, 0.85, 45
DEMOTE_DAYS = (6, 8)
RESERVED_HANDLES = ("i", "intent", "hashtag", "search", "home", "explore", "share")
TRACKING_PARAMS = r"^(utm_.*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|source|s)$"

# Evaluation of discovered accounts.
CANDIDATE_CATEGORIES = ("ai_research", "ai_product", "ads", "infra", "policy", "media", "other")
RECOMMENDATIONS, SAMPLE_QUALITIES = ("reject", "watch", "queue_review"), ("poor", "mixed", "good")
SEVERE_RISK, MAX_RISK_FLAGS = "spam|impersonat", 12
REJECTED_BELOW, LADDER, REVIEW_CONFIDENCE = 45, (65, 78), 0.65
PREFILTER_FOLLOWERS, EVALUATION_LIMIT, PREFILTER_REASON = 100, 20, "PREFILTER: insufficient profile signal"

# Files of community sources.
RESERVED_ROUTES = (
    "about", "account", "ads", "bookmarks", "business", "communities", "compose", "connect", "developers", "download", "explore", "followers", "following", "grok", "hashtag", "help",
    "home", "i", "intent", "lists", "login", "logout", "messages", "notifications", "privacy", "search", "settings", "share", "signin", "signup", "spaces", "status", "topics", "tos",
)
SOURCE_FILE_BYTES, FIRST_SEEN = 2048, "2006-01-01"
GITHUB_LOGIN = r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$"
LANGUAGE_TAG = r"^[a-z]{2}(?:-[A-Z]{2})?$"
TOPIC_CHARACTERS, UNSAFE_TOPIC = r"""^[\p{L}\p{N} .,:;!?'"()&+/-]+$""", r"[\p{Cc}\p{Cf}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}]"

# Marks of trust and badges in editions.
TRUST_BADGES = {"unknown": "未検証/単一ソース", "low": "低信頼"}

# Seeds of prefilter clusters, by shared canonical link, link and title, and where only others tie two items.
SEED_SCORES, CLUSTER_SEED = (1.0, 0.96, 0.9), 0.76

#: Longest range of a digest, in days.
DIGEST_DAYS = 7
