"""Fixed values of the recall gate: patterns by intent, words by lexicon, limits. ``\\b`` is the edge of an ASCII word."""

# Fixed values: (id, pattern) of what asks for memory, for a trace, of what weighs heavily; any case.
MEMORY = (
    ("memory.en.why", r"\bwhy\b"), ("memory.en.when", r"\bwhen\b"), ("memory.en.history", r"\bhistory\b"), ("memory.en.source", r"\bsource\b"),
    ("memory.en.previous", r"\bprevious(ly)?\b"), ("memory.en.before", r"\bbefore\b"), ("memory.en.earlier", r"\bearlier\b"), ("memory.en.repeat", r"\brepeat(ed|ing)?\b"),
    ("memory.en.again", r"\bagain\b"), ("memory.en.remember", r"\bremember\b"), ("memory.en.recall", r"\brecall\b"), ("memory.en.what-did-we", r"\bwhat did we\b"),
    ("memory.en.what-was", r"\bwhat was\b"), ("memory.en.how-did", r"\bhow did\b"), ("memory.en.where-did", r"\bwhere did\b"), ("memory.en.origin", r"\borigin\b"),
    ("memory.en.decided", r"\bdecided\b"), ("memory.kr.왜", "왜"), ("memory.kr.언제", "언제"), ("memory.kr.이전", "이전"), ("memory.kr.예전", "예전"), ("memory.kr.과거", "과거"),
    ("memory.kr.전에", "전에"), ("memory.kr.기록", "기록"), ("memory.kr.출처", "출처"), ("memory.kr.근거", "근거"), ("memory.kr.이유", "이유"), ("memory.kr.히스토리", "히스토리"),
    ("memory.en.history-plain", "history"), ("memory.kr.반복", "반복"), ("memory.kr.또", r"또\s*(그|이)"), ("memory.kr.기억", "기억"), ("memory.kr.다시", "다시"), ("memory.kr.했었", "했었"),
    ("memory.kr.였었", "였었"), ("memory.kr.결정했", "결정했"), ("memory.kr.정했", "정했"), ("memory.kr.바꿨", "바꿨"), ("memory.kr.변경했", "변경했"), ("memory.kr.어디서", "어디서"),
)
TRACE = (
    ("trace.en.why", r"\bwhy\b"), ("trace.en.rationale", r"\brationale\b"), ("trace.en.reason", r"\breason\b"), ("trace.en.related", r"\brelated\b"),
    ("trace.en.depend", r"\bdepend"), ("trace.en.contradict", r"\bcontradict"), ("trace.en.conflict", r"\bconflict"), ("trace.en.architecture", r"\barchitecture\b"),
    ("trace.en.trace", r"\btrace\b"), ("trace.en.history", r"\bhistory\b"), ("trace.en.source", r"\bsource\b"), ("trace.kr.왜", "왜"), ("trace.kr.이유", "이유"),
    ("trace.kr.근거", "근거"), ("trace.kr.관련", "관련"), ("trace.kr.의존", "의존"), ("trace.kr.모순", "모순"), ("trace.kr.충돌", "충돌"), ("trace.kr.아키텍처", "아키텍처"),
    ("trace.kr.추적", "추적"), ("trace.kr.출처", "출처"), ("trace.kr.히스토리", "히스토리"), ("trace.en.history-plain", "history"),
)
HIGH_IMPACT = (
    ("high.en.decide", r"\bdecide\b"), ("high.en.decision", r"\bdecision\b"), ("high.en.switch", r"\bswitch(ing)?\b"), ("high.en.migrate", r"\bmigrat(e|ion)\b"),
    ("high.en.rollback", r"\brollback\b"), ("high.en.roll-back", r"\broll back\b"), ("high.en.revert", r"\brevert\b"), ("high.en.replace", r"\breplace\b"),
    ("high.en.drop", r"\bdrop\b"), ("high.en.remove", r"\bremove\b"), ("high.en.deprecate", r"\bdeprecate\b"), ("high.en.change-the", r"\bchange the\b"),
    ("high.en.adopt", r"\badopt\b"), ("high.en.move-to", r"\bmove to\b"), ("high.kr.결정", "결정"), ("high.kr.전환", "전환"), ("high.kr.마이그레이션", "마이그레이션"),
    ("high.kr.롤백", "롤백"), ("high.kr.되돌", "되돌"), ("high.kr.교체", "교체"), ("high.kr.제거", "제거"), ("high.kr.삭제", "삭제"), ("high.kr.바꾸", "바꾸"),
    ("high.kr.변경", "변경"), ("high.kr.도입", "도입"), ("high.kr.채택", "채택"), ("high.kr.옮기", "옮기"),
)

# Fixed values: (id, pattern) of whole prompts that acknowledge or go on, and of beginnings that correct a trifle.
ACKNOWLEDGEMENT = (
    ("ack.en.1", r"(?i)^(ok|okay|k|yes|yep|yeah|no|nope|sure|thanks|thank you|thx|ty|cool|great|nice|good|got it|understood|done|fine|alright|perfect|sounds good)[.! ]*$"),
    ("ack.kr.1", r"^(응|네|넵|넹|예|아니|아니요|고마워|고마워요|고맙습니다|감사|감사합니다|감사해요|좋아|좋아요|좋네|좋습니다|알겠어|알겠어요|알겠습니다|오케이|ㅇㅋ|ㅇㅇ|ㄱㄱ|굿|맞아|맞아요|그래|그래요|확인)[.! ~]*$"),
)
CONTINUATION = (
    ("continue.en.1", r"(?i)^(continue|go on|keep going|next|proceed|carry on|go ahead|resume)[.! ]*$"),
    ("continue.kr.1", r"^(계속|진행|다음|이어서|이어)(해|하자|해줘|해줘요|해주세요|하세요|할게|할게요|해요|해봐|합시다|가자|으로 넘어가자|으로 넘어가요)?[.! ~]*$"),
    ("continue.kr.2", r"^(가자|고|해줘|해봐|ㄱ)[.! ~]*$"),
)
MINOR_CORRECTION = (
    ("minor.en.1", r"(?i)^(no|not that|the other one|wrong one|other|instead|actually|rather)\b"),
    ("minor.kr.1", r"^(아니|그거 말고|다른 거|다른거|말고|대신|그게 아니라)"),
)

# Words that only acknowledge, only go on, or say nothing by themselves.
ACK_WORDS = (
    "ok okay k yes yep yeah no nope sure thanks thank thx ty cool great nice good got understood done fine alright perfect right awesome "
    "응 네 넵 넹 예 아니 아니요 고마워 고마워요 고맙습니다 감사 감사합니다 감사해요 좋아 좋아요 좋네 좋습니다 알겠어 알겠어요 알겠습니다 오케이 ㅇㅋ ㅇㅇ 굿 맞아 맞아요 그래 그래요 확인"
).split()
CONTINUE_WORDS = (
    "continue go on keep going next proceed carry ahead resume "
    "계속 계속해 계속해줘 계속해줘요 계속해주세요 계속하자 진행 진행해 진행해줘 진행해주세요 진행할게 진행할게요 다음 다음으로 넘어가자 넘어가요 넘어가 이어서 이어 가자 해줘 해주세요 해봐 ㄱㄱ"
).split()
FILLER_WORDS = (
    "you it that this the and then now please let lets s do for with sounds looks work job well really very much so all too "
    "저 그 좀 요 네요 입니다 이제 그럼 그러면 일단"
).split()

# Words without a topic, and the endings that Korean words lose.
STOPWORDS = (
    "the a an to of and or in on for is are it this that with be as at by we i you do can please let me us our my your "
    "은 는 이 가 을 를 에 의 로 으로 와 과 도 좀 그 저 것 수 해 해줘 하자 해요 합니다 있어 없어 그리고 또 그럼"
).split()
KOREAN_ENDING = "(해주세요|해줘요|합니다|하세요|했어요|해요|해줘|해봐|하자|할까|했어|했다|한다|해서|에서|에게|한테|으로|까지|부터|처럼|이랑|은|는|이|가|을|를|의|에|로|와|과|도|만|랑)$"
KOREAN = r"[\x{3131}-\x{D79D}]"

# Limits of the decision, name -> (default, least, greatest); and two that nobody sets.
LIMITS = {
    "ack_max_tokens": (4, 0, 32), "safety_refresh": (6, 1, 100), "drift_jaccard": (0.12, 0.0, 1.0), "drift_min_tokens": (5, 1, 100),
    "coverage_min_tokens": (8, 1, 100), "coherent_margin": (0.08, 0.0, 1.0), "substantive_min_tokens": (5, 1, 100), "coherent_jaccard": (0.35, 0.0, 1.0),
}
SHORT_COHERENT_JACCARD, CORRECTION_TOKENS = 0.3, 2
