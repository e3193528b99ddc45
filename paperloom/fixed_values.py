"""Fixed values.

These must stay as they are for results to be right: sizes, patterns, message
texts and names that other parts of a deployment depend on.
"""

# Chunking
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", ".", "!", "?", ",", " ", ""]

# Retrieval
TOP_K = 3

# Conversations
MESSAGE_CAP = 20

# Documents
RETENTION_HOURS = 24
FILE_SUFFIX = ".pdf"
UUID_PATTERN = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
LANDING_FORMAT = "/Volumes/{catalog}/{schema}/documents/landing"

# Feedback
RATING_MIN = 1
RATING_MAX = 5
RATING_DEFAULT = 3

# Patterns removed from a model's output, in this order; the dot matches newlines
CLEANING_PATTERNS = [
    "(?s)<think>.*?</think>",
    "(?s)Thought:.*?Observation:",
    "(?s)Action:.*?Action Input:.*?Observation:",
]

# Messages
NO_OUTPUT = "No response generated"
ERROR_PREFIXES = {
    "retrieve_document": "Error retrieving documents: ",
    "summarize_text": "Error generating summary: ",
    "translate_text": "Error translating text: ",
    "call_agent": "An error occurred while processing your request: ",
}
EXTRACTION_FAILED = "Failed to extract text from PDF: "
CHUNKING_FAILED = "Failed to chunk document "
DOCUMENT_LABEL = "Document "
DOCUMENTS_PREAMBLE = "Answer questions based on these Context documents:\n"
DOCUMENTS_ACKNOWLEDGED = "Context Documents Acknowledged."

# Table names
DOCUMENT_TABLE = "document"
CHUNK_TABLE = "document_chunks_staging"
ERROR_TABLE = "document_processing_error"
FEEDBACK_TABLE = "user_feedback"

# Prompt names
PROMPT_NAMES = [
    "orchestrator_agent_prompt",
    "document_retrieval_agent_prompt",
    "retrieve_document",
    "summarization_agent_prompt",
    "summarize_text",
    "translation_agent_prompt",
    "translate_text",
]

# Characters that count as white space: those Python's str.split() and
# str.strip() know. Written as a character class that Java and Python read alike.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
