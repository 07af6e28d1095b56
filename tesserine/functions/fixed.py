"""Word lists, patterns and formats that results depend on, in one place."""

# Categories of documents.
CATEGORIES = ["am_thuc", "kien_truc", "le_hoi", "nhac_cu", "the_thao_truyen_thong", "trang_phuc"]

# Words that say nothing about a question's subject, in retrieval.
STOP_WORDS = ["ban", "biet", "chi", "cho", "co", "cua", "duoc", "gi", "gioi", "hay", "hieu", "la", "muon", "toi", "tim", "ve", "viet", "nam"]

# Words of food, which make a question about the new year a narrow one.
FOOD_TERMS = ["am", "banh", "do", "mon", "mut", "thuc"]

# Subjects of the new year's re-ranking, and its bonuses.
BROAD_KEYWORD, BROAD_CATEGORY = "tet nguyen dan", "le_hoi"
NARROW_KEYWORDS = ["mut tet", "tet han thuc", "le hoi banh chung"]
BROAD_KEYWORD_BONUS, BROAD_CATEGORY_BONUS, NARROW_PENALTY = 0.25, 0.12, 0.12

# Words left out of a keyword's subject, in rewriting.
SUBJECT_STOP_WORDS = ["tet", "viet", "nam", "truyen", "thong", "van", "hoa"]

# Endings cut off a lookup key, one after the other.
KEY_SUFFIXES = ["tet", "tết", "vietnam", "viet nam", "việt nam", "traditional", "culture"]

# Rewriting rules in order: the start of a question, and what it becomes.
REWRITE_RULES = [
    (r"^Đây\s+", "{keyword} "),
    (r"^Món này\s+", "{keyword} "),
    (r"^Công trình này\s+", "{keyword} "),
    (r"^Trang phục này\s+", "{keyword} "),
    (r"^Lễ hội này\s+", "{keyword} "),
    (r"^Nhạc cụ này\s+", "{keyword} "),
    (r"^Môn thể thao này\s+", "{keyword} "),
    (r"^Trong hình\s+", "Trong hình về {keyword} "),
    (r"^Hình ảnh này\s+", "Hình ảnh về {keyword} "),
    (r"^Hình ảnh thể hiện\s+", "Hình ảnh về {keyword} thể hiện "),
    (r"^Hình ảnh phản ánh\s+", "Hình ảnh về {keyword} phản ánh "),
    (r"^Tại sao hình ảnh này\s+", "Tại sao hình ảnh về {keyword} "),
    (r"^Ý nghĩa văn hóa của hình ảnh này\s+", "Ý nghĩa văn hóa của {keyword} "),
    (r"^Ý nghĩa văn hoá của hình ảnh này\s+", "Ý nghĩa văn hoá của {keyword} "),
    (r"^Mô tả chi tiết các thành phần trong hình ảnh này", "Mô tả chi tiết các thành phần của {keyword}"),
    (r"^Mô tả chi tiết các thành phần trong hình ảnh", "Mô tả chi tiết các thành phần của {keyword}"),
    (r"^Mô tả chi tiết về hình ảnh này", "Mô tả chi tiết về {keyword}"),
    (r"^Mô tả chi tiết về hình ảnh(?=[.?])", "Mô tả chi tiết về {keyword}"),
    (r"^Mô tả chi tiết những gì bạn thấy trong hình ảnh này", "Mô tả chi tiết những gì bạn thấy về {keyword}"),
    (r"^Mô tả chi tiết những gì bạn thấy trong hình ảnh(?=[.?])", "Mô tả chi tiết những gì bạn thấy về {keyword}"),
    (r"^Mô tả hình ảnh này", "Mô tả {keyword}"),
    (r"^(\w+\s+)?[Nn]ày\s+", "{keyword} "),
]

# Prefixes of answers, taken off in this order.
ANSWER_PREFIXES = ["Câu trả lời:", "Trả lời:", "Answer:"]

# Patterns of the answer sanitizer; letter case is ignored.
VISUAL_TERMS = r"\b(?:hình ảnh|bức ảnh|ảnh chụp|trong ảnh|trong hình|nhìn thấy|cho thấy)\b"
LEADING_VISUAL = (
    r"^\s*(?:hình ảnh|bức ảnh|ảnh|ảnh chụp)(?:\s+(?:này|đó|trên|chụp|về|của|thể hiện|phản ánh|cho thấy))*"
    r"\s*(?:cho thấy|thể hiện|phản ánh|mô tả|chụp|là)?\s*"
)
VISUAL_PHRASES = [
    r"\b(?:trong|qua|từ)\s+(?:hình ảnh|bức ảnh|ảnh chụp|ảnh|hình)\s*(?:này|đó)?\b",
    r"\b(?:hình ảnh|bức ảnh|ảnh chụp|ảnh|hình)\s*(?:này|đó)?\s+(?:cho thấy|thể hiện|phản ánh|mô tả)\s+",
    r"\b(?:có thể\s+)?(?:thấy|nhìn thấy)\s+(?:rằng\s+)?",
    r"\bcho thấy\s+(?:rằng\s+)?",
]
LEADING_CLASSIFIER = r"^(?:một|các|những)\s+(?:đĩa|bát|tô|phần|món|chiếc|cái|cảnh)\s+"
APPOSITION, APPOSITION_AS = r"^([^,.!?]+?),\s+một\s+", "$1 là một "
SENTENCE_ENDS = ".!?。！？"

# The marker after which a document's context stands, and its header.
CONTEXT_MARKER = "Ngữ cảnh văn hóa:"
DOCUMENT_FORMAT = "Chủ đề: %s\nDanh mục: %s\nNgữ cảnh văn hóa: %s"

# Prompts without and with a retrieved context.
PROMPT_WITHOUT = """Bạn là trợ lý trả lời câu hỏi về văn hóa Việt Nam.

Không có ngữ cảnh văn hóa đủ liên quan được truy xuất từ cơ sở tri thức.

Nhiệm vụ:
- Trả lời bằng tiếng Việt.
- Không suy đoán hoặc bịa chi tiết văn hóa khi không có ngữ cảnh đáng tin cậy.
- Đây là bài toán hỏi đáp văn bản, không có ảnh đầu vào. Không dùng các cụm như "ảnh", "hình ảnh", "trong ảnh", "ảnh chụp", "nhìn thấy", "cho thấy" hoặc mô tả thị giác.
- Nếu câu hỏi nằm ngoài phạm vi văn hóa Việt Nam hoặc quá chung chung, hãy nói ngắn gọn rằng bạn có thể hỗ trợ trả lời các câu hỏi về văn hóa Việt Nam.
- Nếu câu hỏi có vẻ thuộc phạm vi văn hóa Việt Nam nhưng thiếu dữ liệu truy xuất, hãy nói rằng bạn chưa có đủ thông tin trong cơ sở tri thức để trả lời chắc chắn.

Câu hỏi:
"""
PROMPT_WITH = """Bạn là trợ lý trả lời câu hỏi về văn hóa Việt Nam dựa trên tri thức truy xuất được.

Nhiệm vụ:
- Trả lời bằng tiếng Việt.
- Chỉ sử dụng các thông tin có trong phần Ngữ cảnh văn hóa khi trả lời nội dung văn hóa cụ thể.
- Đây là bài toán hỏi đáp văn bản, không có ảnh đầu vào. Không dùng các cụm như "ảnh", "hình ảnh", "trong ảnh", "ảnh chụp", "nhìn thấy", "cho thấy" hoặc mô tả thị giác.
- Không mặc định context đầu tiên là đúng nhất; hãy tổng hợp các context liên quan trực tiếp nhất với câu hỏi và ưu tiên chủ đề tổng quát khi câu hỏi mang tính tìm hiểu chung.
- Nếu ngữ cảnh không trực tiếp hỗ trợ câu trả lời, hãy nói rõ rằng thông tin truy xuất chưa đủ.
- Không bịa thêm chi tiết ngoài ngữ cảnh nếu không chắc chắn.
- Câu trả lời nên ngắn gọn, đúng trọng tâm và phù hợp với câu hỏi.

Câu hỏi:
"""
PROMPT_MIDDLE = "\n\nNgữ cảnh văn hóa:\n"

# A user's request in a training chat, with a context and a question.
CHAT_REQUEST = """Dựa vào ngữ cảnh văn hóa được cung cấp, hãy trả lời câu hỏi sau.
[Ngữ cảnh]: %s
[Câu hỏi]: %s"""

# Validation messages.
ISSUES = {
    "no_id": "Missing or empty doc_id.",
    "duplicate": "Duplicate doc_id: '%s'.",
    "no_content": "Missing or empty content.",
    "short": "Content is very short, retrieval quality may be weak.",
    "no_metadata": "Missing metadata object.",
    "no_keyword": "Missing or empty metadata.keyword.",
    "no_category": "Missing or empty metadata.category.",
    "bad_category": "Invalid category '%s'.",
    "no_subcategory": "Missing metadata.subcategory.",
    "no_base_image": "Missing metadata.base_image_id.",
    "ids_not_list": "metadata.source_image_ids should be list[str].",
    "ids_empty": "metadata.source_image_ids is empty.",
    "count_not_int": "metadata.source_count should be an integer.",
    "count_differs": "metadata.source_count does not match len(metadata.source_image_ids).",
    "keyword_absent": "metadata.keyword does not appear in content.",
    "id_format": "doc_id should follow <category>|<subcategory>|<hash>.",
    "id_category": "doc_id category does not match metadata.category.",
    "id_subcategory": "doc_id subcategory does not match metadata.subcategory.",
}

# Recommendations of the report.
RECOMMENDATIONS = {
    "validation": "Fix knowledge_base validation errors before rebuilding Vector DB.",
    "warnings": "Review validation warnings. Warnings may not block RAG, but they can hide metadata quality issues.",
    "build": "Rebuild full Vector DB and ensure vector_db.count_after equals total_documents.",
    "retrieval": "Improve retrieval quality: check eval expected_keyword, keyword normalization, parent/child keywords, and consider top_k=5.",
    "top_k": "Top-k keyword accuracy is higher than top-1. Use top_k=3 or top_k=5 in inference instead of relying only on rank 1.",
}
