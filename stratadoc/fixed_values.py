"""Vocabularies, limits, texts and patterns that results must agree on."""

# Allowed node labels and relation types of the entity graph.
NODE_LABELS = ("Person", "Organization", "Location", "Concept", "Document", "Event", "Product")
RELATION_TYPES = (
    "WORKS_FOR",
    "LOCATED_IN",
    "RELATES_TO",
    "MENTIONS",
    "PART_OF",
    "CREATED_BY",
    "HAS_FEATURE",
)

# Sizes and limits.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
SEPARATORS = ("\n\n", "\n", ".", " ", "")
CONFIG_SEPARATORS = ("\n\n", "\n", " ", "")
EMBED_DIM = 64
SEARCH_LIMIT = 5
TOOL_SEARCH_LIMIT = 3
GRAPH_CONTEXT_LIMIT = 5
GRAPH_TOOL_LIMIT = 10
CACHE_THRESHOLD = 0.95
HISTORY_LIMIT = 10
CHAT_HISTORY_LIMIT = 6
RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60
EXCERPT_CHARS = 200
SLUG_CHARS = 120
TARGET_PAGES = 50
CANDIDATE_PAGES = 70
COMPLETION_TRIES = 3
BM25_K1 = 1.2
BM25_B = 0.75
ACCEPTED_SUFFIXES = ("pdf", "docx", "txt", "html")

# Messages and defaults.
NO_DOCUMENTS = "No relevant documents found."
NO_ENTITIES = "No specific entities identified to search."
NO_CONNECTIONS = "No knowledge graph connections found."
NO_TOOL = "No tool selected."
UNKNOWN_TOOL = "Unknown tool requested."
TOOL_PREFIX = "Tool Output:"
TOOL_NAMES = ("calculator", "graph_search", "vector_search", "web_search")
PLAN_DONE = "Planning completed."
PLAN_FAILED = "Error in planning, defaulting to retrieval."
INTERNAL_ERROR = "An internal error occurred."
LABEL_TOOL = "tool output"
LABEL_CONTEXT = "retrieved context"

# Characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Corpus selection.
SITE = "https://kubernetes.io"
DEFAULT_TITLE = "Kubernetes Documentation"
API_SECTION = "/docs/reference/kubernetes-api/"
API_ALLOWED = ("api-index", "labels-annotations-taints")
SECTIONS = (
    ("/docs/concepts/", "concepts"),
    ("/docs/tasks/", "tasks"),
    ("/docs/tutorials/", "tutorials"),
    ("/docs/setup/", "setup"),
    ("/docs/reference/", "reference"),
    ("/docs/home", "home"),
)
QUOTAS = (("home", 1), ("concepts", 18), ("tasks", 16), ("tutorials", 6), ("setup", 5), ("reference", 4))

# Prompt texts sent to the completion function.
GRAPH_PROMPT = """
        You are a Knowledge Graph extraction engine. 
        Extract nodes and relationships from the text.
        
        Allowed Node Labels: {labels}
        Allowed Relationship Types: {relations}
        
        Return JSON format only:
        {{
            "nodes": [{{"id": "Name", "type": "Label"}}],
            "edges": [{{"source": "Name", "target": "Name", "type": "RELATION"}}]
        }}
        """
GRAPH_PROMPT_FRAME = """
                {system}

                Input Text:
                {text}
                """

PLAN_PROMPT = """
You are a RAG Planning Agent.
Analyze the User Query and Conversation History.

Primary domain: Kubernetes documentation.
Default behavior: prefer "retrieve" for Kubernetes questions.

Decide the next step:
1. If the user greets (Hello/Hi), output "direct_answer".
2. If the question is about Kubernetes concepts, APIs, behavior, troubleshooting, or best practices, output "retrieve".
3. Use "tool_use" only when retrieval is not the best fit (for example: explicit math evaluation, explicit graph relation lookup, explicit vector lookup, or explicit web lookup).
4. If you choose "tool_use", pick one tool:
   - calculator: evaluate math expressions.
   - graph_search: search knowledge graph relations/entities.
   - vector_search: search vector database passages.
   - web_search: search public web for recent/external information.

Output JSON format ONLY:
{
    "action": "retrieve" | "direct_answer" | "tool_use",
    "refined_query": "The standalone search query",
    "tool_choice": "calculator" | "graph_search" | "vector_search" | "web_search" | "",
    "tool_input": "input string for selected tool, empty when not tool_use",
    "reasoning": "Why you chose this action"
}
"""

REWRITE_PROMPT = """
You are a Query Rewriter. 
Your task is to rewrite the latest user question to be a standalone search query, 
resolving coreferences (he, she, it, they) using the conversation history.

History:
{history}

Latest Question: {question}

Output ONLY the rewritten question. If no rewriting is needed, output the latest question as is.
"""

HYDE_PROMPT = """
You are a helpful assistant. 
Write a hypothetical paragraph that answers the user's question. 
It does not need to be factually correct, but it must use the correct vocabulary and structure 
that a relevant document would have.

Question: {question}
"""

ENTITY_PROMPT = """
You are a Knowledge Graph Helper.
Extract the core entities from the user's question to perform a search.

Question: {question}

Output JSON only:
{
    "entities": ["list", "of", "names"]
}
"""

ANSWER_PROMPT = """
    You are a helpful Enterprise Assistant. Use the provided source to answer the user's question.

    Source Type:
    {label}

    Source Content:
    {content}

    Question: 
    {question}

    Instructions:
    1. If source type is retrieved context, cite sources using [Source: Filename] when available.
    2. If source type is tool output, answer directly from that output.
    3. If the source does not contain the answer, say you do not have enough information.
    4. Be concise and professional.
    """
