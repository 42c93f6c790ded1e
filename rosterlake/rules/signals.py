"""Keyword and domain dictionaries.  Fixed values; every operator also takes
its dictionary as an argument, these are the defaults."""

# --- region relevance, field-weighted scorer -------------------------------
REGION_SIGNALS = {
    "official_domains": (
        "twse.com.tw", "tpex.org.tw", "taifex.com.tw", "cwa.gov.tw",
        "moi.gov.tw", "moea.gov.tw", "moj.gov.tw", "ly.gov.tw",
        "judicial.gov.tw", "data.gov.tw", "gov.tw",
    ),
    "government_agencies": (
        "CWA", "MOI", "MOEA", "MOL", "MOF", "PCC", "LY",
        "Judicial Yuan", "data.gov.tw", "gov.tw",
    ),
    "financial_keywords": (
        "TWSE", "TPEx", "TAIFEX", "TDCC", "FinMind", "Fugle",
        "台股", "上市", "上櫃",
    ),
    "dataset_keywords": (
        "實價登錄", "LVR", "land.moi.gov.tw", "房價", "房地產", "土地", "預售屋",
    ),
    "payment_keywords": ("ECPay", "NewebPay", "綠界", "藍新"),
    "taiwan_keywords": ("Taiwan", "Taiwanese", "台灣", "臺灣", "TW", "Taipei"),
    "language_keywords": (
        "zh-TW", "繁體中文", "繁體", "Traditional Chinese",
        "Taiwan Mandarin", "注音", "TOCFL",
    ),
    "company_keywords": ("SHOPLINE",),
}

# --- AI relevance ----------------------------------------------------------
AI_SIGNALS = {
    "core_ai_keywords": (
        "AI", "Artificial Intelligence", "LLM", "Large Language Model",
        "Generative AI", "GenAI", "Machine Learning", "Deep Learning",
    ),
    "agent_keywords": (
        "agent", "agentic", "AI agent", "AI assistant", "autonomous agent",
    ),
    "rag_keywords": (
        "RAG", "retrieval", "embedding", "vector", "vector database",
        "semantic search",
    ),
    "llm_provider_keywords": (
        "Claude", "ChatGPT", "Gemini", "OpenAI", "Anthropic", "Cohere",
        "Mistral", "Llama",
    ),
    "mcp_keywords": (
        "MCP", "Model Context Protocol", "tool calling", "function calling",
        "AI workflow",
    ),
    "framework_keywords": (
        "LangChain", "LlamaIndex", "AutoGen", "CrewAI", "Semantic Kernel",
        "LangGraph",
    ),
    "package_patterns": (
        "@modelcontextprotocol/", "langchain", "llamaindex", "openai",
        "anthropic", "google-generativeai",
    ),
}

# --- older region scorer: ordered keyword groups, first group wins ----------
LEGACY_KEYWORD_GROUPS = (
    ("government", ("Taiwan", "Taiwanese", "台灣", "臺灣", "TW", "zh-TW", "繁體中文", "繁體")),
    ("government_domain", (
        "data.gov.tw", "gov.tw", "moi.gov.tw", "moea.gov.tw", "mof.gov.tw",
        "mohw.gov.tw", "cwa.gov.tw", "ly.gov.tw", "judicial.gov.tw", "law.moj.gov.tw",
    )),
    ("finance", ("TWSE", "TPEx", "TAIFEX", "TDCC", "FinMind", "Fugle", "台股", "上市", "上櫃")),
    ("real_estate", ("實價登錄", "LVR", "land.moi.gov.tw", "房價", "房地產", "土地", "預售屋")),
    ("payment", ("ECPay", "NewebPay", "綠界", "藍新")),
    ("language", ("Taiwan Mandarin", "Traditional Chinese", "zh-TW", "注音", "TOCFL")),
    ("company_service", ("SHOPLINE",)),
    ("data_source", (
        "twse.com.tw", "tpex.org.tw", "taifex.com.tw", "cwa.gov.tw", "moi.gov.tw",
        "moea.gov.tw", "moj.gov.tw", "ly.gov.tw", "judicial.gov.tw", "data.gov.tw",
        "ECPay", "NewebPay", "SHOPLINE",
    )),
)
LEGACY_GROUP_POINTS = {"finance": 20, "government": 15, "language": 15, "company_service": 15}
LEGACY_DEFAULT_POINTS = 5
LEGACY_OFFICIAL_DOMAINS = (
    "twse.com.tw", "tpex.org.tw", "taifex.com.tw", "cwa.gov.tw", "moi.gov.tw",
    "moea.gov.tw", "moj.gov.tw", "ly.gov.tw", "judicial.gov.tw", "data.gov.tw",
)
LEGACY_DOMAIN_POINTS = 40
LEGACY_SOURCE_POINTS = 35

# --- whole-text scorers used by the live pipeline ---------------------------
INLINE_REGION_KEYWORDS = (
    "taiwan", "taipei", "taiwanese", "台灣", "臺灣", "台灣人工智慧",
    "twse", "taiex", "fin", "mof", "data.gov.tw",
)
INLINE_REGION_POINTS = 15
INLINE_REGION_URL_MARKS = (".tw", "data.gov.tw", "taiwan", "twse", "taiex")
INLINE_REGION_URL_POINTS = 40
INLINE_AI_KEYWORDS = (
    "ai", "llm", "gpt", "llama", "rag", "embedding", "generative", "neural",
    "transformer", "chatbot", "langchain", "llamaindex",
)
INLINE_AI_POINTS = 20
INLINE_AI_COMBO_WORD = "taiwan"
INLINE_AI_COMBO_POINTS = 10

# --- known data sources: domain -> type ------------------------------------
KNOWN_SOURCES = {
    "twse.com.tw": "official_gov_api",
    "tpex.org.tw": "official_gov_api",
    "taifex.com.tw": "official_gov_api",
    "cwa.gov.tw": "official_gov_api",
    "moi.gov.tw": "official_gov_api",
    "moea.gov.tw": "official_gov_api",
    "data.gov.tw": "official_gov_api",
    "ecpay.com.tw": "official_company",
    "newebpay.com": "official_company",
    "shoplineapp.com": "official_company",
    "finmind.com.tw": "third_party_api",
    "fugle.com.tw": "third_party_api",
}

# --- slug pre-filter --------------------------------------------------------
SLUG_REGION_TOKENS = (
    "taiwan", "taipei", "taichung", "tainan", "kaohsiung", "twse", "taifex",
    "tpex", "mops", "gov.tw", "edu.tw", "台灣", "臺灣",
)
SLUG_PROTOCOL_TOKENS = ("-mcp", "mcp-", "_mcp", "mcp_", "mcpserver", "mcp_server")

# --- text clean-up -----------------------------------------------------------
REDACT_PHRASES = (
    "Ignore previous instructions",
    "Call this URL",
    "Upload credentials",
)
OBFUSCATION_MARKS = (
    "return(function(", "return(function ", "local ny=type", "string.byte",
    "\\x5f\\x5f",
)
