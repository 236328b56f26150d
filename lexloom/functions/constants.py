"""Word lists, patterns and weights that decide results."""

# Stop words of the taggers.
STOPWORDS_KO = "그리고 하지만 또한 그러나 따라서 때문 관련 대해서 위해 하여 하는 한다 함 입니다 있습니다 없습니다 가능 불가 확인 조치 방법 절차 가이드 매뉴얼 서버 시스템 환경 설정 구성 적용 변경 필요 권장 주의 리스크 오류 장애 현상 원인 해결 대응".split()
STOPWORDS_EN = "the a an and or but if then else for to of in on at by with is are was were be been being this that these those check confirm apply change need required recommended note risk error issue failure failed timeout exception server system config configuration setting guide manual procedure".split()

# Canonical spelling and its aliases; the first canonical in this order wins.
SYNONYMS = {
    "jeus": ["제우스"],
    "webtob": ["웹투비", "web to b", "web-to-b"],
    "tomcat": ["톰캣"],
    "postgresql": ["postgres", "포스트그레스", "포스트그레", "포스트그레sql", "pg"],
    "oracle": ["오라클"],
    "tibero": ["티베로"],
    "xedrm": ["xe drm", "xedrm5", "xedrm6"],
    "xedm": ["xe dm", "xedm5", "xedm6"],
    "port": ["포트"],
    "pid": ["프로세스id", "프로세스 id"],
    "netstat": ["넷스탯"],
    "kill": ["강제종료", "종료"],
    "rollback": ["롤백"],
    "restart": ["재기동", "재시작", "리스타트"],
    "issue": ["오류", "장애", "에러", "실패", "현상"],
    "resolution": ["해결", "조치", "완료", "대응"],
    "procedure": ["가이드", "매뉴얼", "절차", "방법", "설정"],
    "report": ["보고", "리포트", "분석", "요약", "현황"],
}

# Patterns of the tagger's genres, in order of precedence; \b is the boundary of a Unicode word.
GENRE_RULES = {
    "issue": [r"\berror\b", r"\bexception\b", r"\bfail(ed|ure)?\b", r"\btimeout\b", "오류", "장애", "실패", "예외", "타임아웃", "noroutetohost", r"ora-\d+"],
    "resolution": [r"\bfix\b", r"\bresolve(d)?\b", r"\bworkaround\b", r"\brollback\b", r"\brestart\b", "해결", "조치", "완료", "수정", "롤백", "재기동", "재시작"],
    "procedure": [r"\bhow to\b", r"\bprocedure\b", r"\bguide\b", r"\bchecklist\b", r"\bconfiguration\b", "가이드", "매뉴얼", "절차", "체크리스트", "설정", "구성"],
    "report": [r"\breport\b", r"\banalysis\b", r"\bsummary\b", r"\bresult\b", "보고", "분석", "요약", "결과", "현황"],
    "application": [r"\bapplication\b", r"\bapply\b", r"\brequest\b", r"\b신청\b", r"\b신청서\b", r"\b제출\b", r"\b지원\b", r"\bapplication form\b", r"\b신청 양식\b"],
    "form": [r"\bform\b", r"\btemplate\b", r"\b양식\b", r"\b서식\b", r"\b템플릿\b", r"\bformat\b", r"\b서식 파일\b", r"\b양식 파일\b"],
    "maintenance": [r"\bmaintenance\b", r"\b유지보수\b", r"\b점검\b", r"\b정기\b", r"\bcheck\b", r"\b점검서\b", r"\b유지\b", r"\b보수\b", r"\bmaintain\b"],
    "guide": [r"\bguide\b", r"\bmanual\b", r"\b설명서\b", r"\b가이드북\b", r"\b매뉴얼\b", r"\b사용법\b", r"\b사용 가이드\b", r"\btutorial\b"],
    "record": [r"\brecord\b", r"\b기록\b", r"\b일지\b", r"\b로그\b", r"\b이력\b", r"\bhistory\b", r"\b기록서\b"],
}

# Patterns of the light classifier's genres, in order of precedence.
GENRE_RULES_LIGHT = {
    "issue": ["error", "exception", "장애", "오류", "fail", "실패", "cannot", "no route", "timeout"],
    "resolution": ["조치", "해결", "완료", "수정", "재기동", "rollback", "롤백"],
    "procedure": ["절차", "가이드", "매뉴얼", "방법", "how to", "설정 방법", "체크리스트"],
    "policy": ["정책", "규정", "표준", "준수", "보안", "권한"],
    "report": ["보고", "결과", "분석", "리포트", "요약", "현황"],
    "communication": ["회의", "통화", "메일", "요청", "문의", "답변"],
    "plan": ["계획", "일정", "roadmap", "todo", "task"],
    "contract": ["계약", "제안", "견적", "사업", "발주"],
    "reference": ["개념", "참고", "링크", "용어", "정리"],
    "application": ["application", "apply", "request", "신청", "신청서", "제출", "지원"],
    "form": ["form", "template", "양식", "서식", "템플릿", "format"],
    "maintenance": ["maintenance", "유지보수", "점검", "정기", "check", "점검서", "유지", "보수"],
    "guide": ["guide", "manual", "설명서", "가이드북", "사용법", "tutorial"],
    "record": ["record", "기록", "일지", "로그", "이력", "history", "기록서"],
}

# Weights of words in documents of a genre.
GENRE_WEIGHTS = {
    "procedure": {"설정": 1.5, "실행": 1.5, "확인": 1.4, "적용": 1.4, "구성": 1.4, "configure": 1.5, "execute": 1.5, "check": 1.4, "apply": 1.4, "step": 1.3, "단계": 1.3, "절차": 1.3, "procedure": 1.3},
    "report": {"결과": 1.5, "분석": 1.4, "현황": 1.4, "통계": 1.4, "데이터": 1.3, "result": 1.5, "analysis": 1.4, "summary": 1.4, "statistics": 1.4, "report": 1.3, "data": 1.3},
    "issue": {"오류": 1.6, "장애": 1.6, "문제": 1.5, "원인": 1.5, "증상": 1.4, "error": 1.6, "issue": 1.6, "failure": 1.5, "cause": 1.5, "symptom": 1.4, "exception": 1.5, "timeout": 1.4},
    "resolution": {"해결": 1.6, "조치": 1.5, "수정": 1.5, "완료": 1.4, "대응": 1.4, "fix": 1.6, "resolve": 1.6, "solution": 1.5, "workaround": 1.4, "rollback": 1.4, "restart": 1.3},
    "application": {"신청": 1.5, "제출": 1.4, "지원": 1.4, "신청서": 1.5, "application": 1.5, "apply": 1.4, "submit": 1.4, "request": 1.3},
    "form": {"양식": 1.5, "서식": 1.5, "템플릿": 1.4, "format": 1.4, "form": 1.5, "template": 1.4},
    "maintenance": {"점검": 1.5, "유지보수": 1.5, "정기": 1.4, "점검서": 1.5, "maintenance": 1.5, "check": 1.4, "inspection": 1.4},
    "guide": {"가이드": 1.5, "매뉴얼": 1.5, "설명서": 1.4, "사용법": 1.4, "guide": 1.5, "manual": 1.5, "tutorial": 1.4},
    "record": {"기록": 1.5, "일지": 1.5, "로그": 1.4, "이력": 1.4, "record": 1.5, "log": 1.4, "history": 1.4},
}

# Words that raise the search score of documents of a genre; the first one in the query counts.
SEARCH_WEIGHTS = {
    "procedure": {"단계": 1.3, "step": 1.3, "절차": 1.2, "procedure": 1.2},
    "report": {"결과": 1.3, "result": 1.3, "분석": 1.2, "analysis": 1.2, "통계": 1.2},
    "issue": {"문제": 1.4, "issue": 1.4, "오류": 1.3, "error": 1.3, "원인": 1.2},
    "resolution": {"해결": 1.4, "solution": 1.4, "조치": 1.3, "fix": 1.3},
}

# Product names that count as entities.
PRODUCTS = ["JEUS", "WebtoB", "Tomcat", "PostgreSQL", "Oracle", "Tibero", "XEDRM", "XEDM"]

# Wordings of answers that tell nothing.
DENY_PHRASES = ["찾을 수 없습니다", "정보를 찾을 수 없습니다", "검색 결과가 없습니다", "해당 내용을 찾지 못했습니다", "다시 질문해 주시겠어요", "질문을 다시 확인해 주세요", "관련 정보를 찾지 못했습니다"]

# Error codes and exceptions, by which a phrase counts as a term of the domain.
ERROR_PATTERNS = [r"ORA-\d+", "SQLSTATE", r"ERROR\s*\d+", "NullPointerException", "OutOfMemoryError", "StackOverflowError"]
