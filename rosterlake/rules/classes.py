"""Word lists of the classifier and the identity detector.  Fixed values."""

# --- source-code tokens (case-sensitive substrings) ---------------------------
SERVER_IMPL = ("McpServer", "mcp.Server")
STDIO_TRANSPORT = ("StdioServerTransport", "stdio.ServerTransport")
TOOL_DEFS = ("tools.List", "tool.Definition", "tools.ListChanged")
EXECUTABLE_MARKS = ('"bin"', "bin:")
EXECUTABLE_MAIN = "package main"
CLIENT_IMPL = ("mcp.Client", "McpClient")
CLIENT_BLOCKERS = ("McpServer", "StdioServerTransport")
HOST_IMPL = ("McpHost", "mcp.Host", "host.Manager", "MultiServer")
SDK_PACKAGES = ("@modelcontextprotocol/sdk", "mcp-sdk", "mcp_sdk")
SDK_TOPICS = ("mcp-sdk", "mcp_sdk")
EXTENSION_IMPL = ("McpExtension", "mcp.Extension", "extension.Plugin")
SKILL_IMPL = ("McpSkill", "mcp.Skill", "skill.Definition")
AGENT_IMPL = ("Agent", "agent.Executor", "autonomous", "planner", "reasoning", "chain-of-thought")
TOOL_IMPL = ("tool.Function", "ToolDefinition")
AI_SKILL_WORD = "Skill"
AI_SKILL_FORMS = ("skill.Definition", "Skill(")

# --- lower-case words -----------------------------------------------------------
COLLECTION_WORDS = ("awesome", "list", "collection", "registry", "curated", "index", "catalog")
MANY_LINKS_TEXT = "github.com/"
MANY_LINKS = 10
AI_SDK_PACKAGES = (
    "langchain", "llamaindex", "autogen", "crewai", "semantic-kernel", "langgraph",
    "openai-sdk", "anthropic-sdk", "google-generativeai", "cohere-sdk",
)
FRAMEWORK_WORDS = (
    "langchain", "llamaindex", "autogen", "crewai", "semantic-kernel", "langgraph", "haystack",
)
KNOWLEDGE_WORDS = (
    "knowledge", "knowledge-base", "vector-db", "vector-database", "embeddings", "rag", "retrieval",
)
DATASET_SOURCE_TYPES = ("official_gov_api", "open_data", "official", "community")
DATASET_WORDS = ("dataset", "data", "database", "csv", "parquet", "sql")
API_WORDS = ("api", "wrapper", "client", "sdk", "rest", "graphql")
APPLICATION_WORDS = ("app", "application", "web", "ui", "frontend", "dashboard", "chat", "bot")
INFRA_WORDS = (
    "infrastructure", "platform", "deploy", "kubernetes", "k8s", "operator", "orchestration",
)
PLUGIN_WORDS = ("plugin", "extension", "addon", "integration", "hook")
TUTORIAL_WORDS = ("tutorial", "guide", "howto", "walkthrough", "example", "learn", "getting-started")
EXAMPLE_WORDS = ("example", "demo", "sample", "showcase", "starter", "boilerplate")
AI_COLLECTION_WORDS = ("awesome", "list", "collection", "curated", "resources", "links")
REGISTRY_WORDS = ("registry", "catalog", "index", "directory", "marketplace")

# --- guard before the ordered rules ----------------------------------------------
SERVER_CLAIMS = ("mcp server", "model context protocol server", "fastmcp", "stdio_server")
DATA_LIBRARY_PHRASES = (
    "data library", "data sdk", "market data", "stock data", "data pipeline",
    "data feed", "data api", "stock api", "twse api", "tpex api",
    "金融資料", "股市資料", "市場資料",
)
DATA_LIBRARY_NAMES = ("twmarket", "twstock", "twdata", "taiwandata", "fugle")
DATA_INFRA_PHRASES = (
    "database schema", "migration system", "etl", "data warehouse", "data pipeline",
    "data layer", "postgres schema", "postgresql schema", "alembic", "flyway",
    "prisma schema", "knex migrations",
)
DATA_INFRA_TOPICS = ("database", "schema", "etl", "postgres", "postgresql", "sqlalchemy")

# --- identity detector -------------------------------------------------------------
IMPORTS_GO = ("github.com/modelcontextprotocol/go-sdk/mcp", "modelcontextprotocol/go-sdk/mcp")
IMPORTS_JS = (
    "@modelcontextprotocol/sdk", "@modelcontextprotocol/sdk/client",
    "@modelcontextprotocol/sdk/server",
)
IMPORTS_PY = ("mcp", "mcp.server", "mcp.client")
ID_SERVER_IMPL = ("McpServer", "mcp.Server", "server.McpServer", "NewMcpServer")
ID_TRANSPORTS = (
    "StdioServerTransport", "stdio.ServerTransport", "SSEServerTransport",
    "sse.ServerTransport", "StreamableHTTPServerTransport", "streamablehttp.ServerTransport",
)
ID_TOOL_DEFS = ("tools.List", "tool.Definition", "tools.ListChanged", "mcp.Tool", "server.Tool")
ID_CLIENT_IMPL = ("mcp.Client", "McpClient", "client.Initialize", "ClientTransport")
ID_HOST_STRUCT = "type Host struct"
ID_HOST_STRUCT_PARTS = ("clients []*mcp.Client", "AddServer", "StartAll")
ID_EXTENSION_IMPL = (
    "McpExtension", "mcp.Extension", "extension.Plugin", "CustomTransport", "BaseTransport",
)
ID_SKILL_IMPL = ("McpSkill", "mcp.Skill", "skill.Definition", "type Skill struct")
ID_CODE_WORDS = ("import ", "package ", "func ", "type ", "const ", "var ")
ID_README_WORDS = ("mcp", "model context protocol")
ID_TUTORIAL_WORDS = (
    "tutorial", "guide", "howto", "walkthrough", "example", "demo", "sample",
    "showcase", "starter", "boilerplate", "learn", "getting-started",
)

# --- evidence weights ----------------------------------------------------------------
IDENTITY_WEIGHTS = {
    "mcp_keyword": 5, "mcp_topic": 5, "mcp_sdk_dependency": 10, "mcp_server_classes": 25,
    "mcp_tool_definitions": 15, "executable_entrypoint": 15, "valid_server_config": 10,
    "runtime_handshake": 20, "tools_list_success": 10, "resources_list_success": 5,
    "prompts_list_success": 5,
}
# rule names the detector emits -> name the weight table uses
IDENTITY_RULE_ALIASES = {
    "mcp_server_impl": "mcp_server_classes",
    "tool_definitions": "mcp_tool_definitions",
    "mcp_library_dependency": "mcp_sdk_dependency",
    "mcp_dependency": "mcp_sdk_dependency",
    "mcp_runtime_endpoint": "valid_server_config",
}
WEAK_RULES = ("mcp_keyword", "mcp_topic")
BRIDGE_RULES = WEAK_RULES + ("mcp_sdk_dependency",)
RUNTIME_RULES = (
    "runtime_handshake", "tools_list_success", "resources_list_success", "prompts_list_success",
)
TYPE_WEIGHTS = {"SOURCE_CODE": 3.0, "RUNTIME": 5.0, "PACKAGE_MANIFEST": 2.0, "README": 1.0}
TYPE_WEIGHT_DEFAULT = 0.5

# --- evidence kinds: source and rule written for each -----------------------------------
EVIDENCE_KINDS = {
    "SOURCE_CODE": ("source_code", "source_code_match"),
    "PACKAGE_MANIFEST": ("package_manifest", "package_manifest_match"),
    "README": ("readme", "readme_match"),
    "RUNTIME": ("runtime", "runtime_match"),
    "RULE_MATCH": ("", None),
}
SNIPPET_LIMIT = 200

# --- heuristic seeding, fixed values: ordered (class, words), names first, then name + description -------
NAME_RULES = (
    ("AI_TUTORIAL", ("tutorial", "demo", "example", "getting-started", "how-to")),
    ("MCP_COLLECTION", ("awesome-", "-awesome", "awesome_", "-collection", "curated-", "-awesome-list")),
    ("AI_FRAMEWORK", ("-framework", "_framework", "framework-", "orchestrator", "crewai", "langgraph")),
    ("AI_AGENT", ("-agent", "_agent", "agent-", "agent_", "react-agent", "crew-", "chatbot")),
    ("AI_SDK", ("-sdk", "_sdk", "sdk-", "client-py", "client-go", "client-ts")),
    ("AI_DATASET", ("twmarket", "twstock", "twdataset", "taiwandata", "data-", "finmind", "fugle-data")),
    ("AI_TOOL", ("cli", "-cli", "_cli", "cli-", "cmd-")),
)
TEXT_RULES = (
    ("AI_FRAMEWORK", ("orchestration framework", "workflow engine", "agent framework",
                      "multi-agent orchestration")),
    ("AI_AGENT", ("ai agent", "agentic", "autonomous agent", "react agent", "multi-agent system",
                  "chatbot powered by")),
    ("AI_DATASET", ("data library", "market data", "stock data", "data feed", "data pipeline",
                    "data api", "etl pipeline", "postgres schema", "twse api", "tpex api",
                    "taiwan stock data", "taiwan market data")),
    ("AI_SDK", ("client library", "python sdk", "go sdk", "typescript sdk", "rust sdk")),
    ("AI_TUTORIAL", ("tutorial", "getting started", "step-by-step", "minimal example")),
    ("MCP_COLLECTION", ("awesome list", "curated list", "awesome collection", "list of mcp")),
    ("AI_TOOL", ("command-line", "command line tool")),
)
SEED_DEFAULT = "MCP_SERVER"
