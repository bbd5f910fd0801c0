"""Short texts that stand in place of content: general examples for the models of ``page_tree`` and ``residue``.

They are what servers, browsers and editors commonly say in seven languages; most
of what the models learn of notices comes from the pages of the sample that hold
nothing else (see ``page_labels.bare_pages``).
"""

from __future__ import annotations

from http import HTTPStatus

import numpy as np

#: Reason phrases of failed requests, as servers print them.
STATUS_LINES = tuple(x for s in HTTPStatus if s >= 400 for x in (f"{s.value} {s.phrase}", s.phrase, f"Error {s.value}"))

#: Common notices of missing pages, refused access, failures and scripts.
NOTICES = (
    # English
    "The page you requested could not be found.", "You are not allowed to open this page.", "The server is temporarily unable to answer your request.", "Please try again later.",
    "JavaScript is disabled in your browser.", "This content cannot be shown without scripts.", "Your browser is not supported.", "Please complete the captcha to continue.",
    "Please sign in again to continue.", "This address is no longer in use.", "An error occurred. Error code 0x80070005", "Reload the page", "Try again", "Go to the start page",
    "We are checking your browser.", "The site is closed for maintenance.", "Request ID 7f3a2b1c",
    # German
    "Diese Seite konnte nicht gefunden werden.", "Dienst nicht verfügbar", "Zu viele Anfragen", "Sie haben keine Berechtigung, diese Seite zu sehen.", "Der Server wird gerade gewartet.",
    "Ihr Browser führt keine Skripte aus.", "Es ist ein Fehler aufgetreten. Fehlercode 1a2b3c4d", "Bitte laden Sie die Seite neu.", "Zur Startseite",
    # French
    "Cette page est introuvable.", "Service indisponible", "Trop de requêtes", "Vous n’avez pas l’autorisation de consulter cette page.", "Le serveur est en maintenance.",
    "Votre navigateur n’exécute pas les scripts.", "Une erreur s’est produite. Code d’erreur 1a2b3c4d", "Rechargez la page.", "Retour à l’accueil",
    # Spanish
    "No se ha encontrado la página.", "Servicio no disponible", "Demasiadas solicitudes", "No está autorizado a ver esta página.", "El servidor está en mantenimiento.",
    "Su navegador no ejecuta scripts.", "Ha ocurrido un error. Código de error 1a2b3c4d", "Recargue la página.", "Ir a la página de inicio",
    # Portuguese
    "Esta página não foi encontrada.", "Serviço indisponível", "Muitas solicitações", "Sem autorização para ver esta página.", "O servidor está em manutenção.",
    "Seu navegador não executa scripts.", "Houve um erro. Código do erro 1a2b3c4d", "Recarregue a página.", "Ir para o início",
    # Russian
    "Такой страницы нет.", "Сервис недоступен", "Слишком много запросов", "У вас нет прав на просмотр этой страницы.", "Сервер на обслуживании.",
    "Ваш браузер не выполняет скрипты.", "Произошла ошибка. Код ошибки 1a2b3c4d", "Обновите страницу.", "На главную",
    # Chinese
    "找不到该页面。", "服务不可用", "请求过于频繁", "您没有权限查看此页面。", "服务器正在维护。", "您的浏览器未运行脚本。", "发生错误，错误代码1a2b3c4d", "请刷新页面。", "回到首页",
)

#: What editors leave in a page for its author.
INSTRUCTIONS = ("Type your text here", "Add a description", "Replace this text with your own", "Enter a title", "Write something", "This is a placeholder", "Text goes here", "Insert an image here")
#: What programs print for a value that is missing.
VOID_VALUES = ("undefined", "null", "NaN", "None", "[object Object]", "N/A", "TBD", "TODO")


def notice_examples(copies: int) -> list[str]:
    """The notices ``copies`` times each, and the reason phrases once."""
    return [x for x in NOTICES for _ in range(copies)] + list(STATUS_LINES)


def slot_examples(n: int, seed: int = 6) -> list[str]:
    """Bare template fields in the usual notations, with names put together at random, and missing values."""
    rng = np.random.default_rng(seed)
    forms = ("{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "${{{{{}}}}}", "#{{{}}}", "%%{}%%", "__{}__", "@@{}@@", "[[{}]]", "<%= {} %>", "{{% {} %}}", "{{{}}}", "&&{}&&", "<<{}>>", "${}$", "!{}!", "<{}>", "[{}]")
    parts = "page title body card text intro lead photo credit author full item label period from place name object summary sub head line foot quote caption teaser".split()
    out = []
    for i in range(n):
        words = list(rng.choice(parts, rng.integers(1, 4)))
        name = ("_".join(words), ".".join(words), "".join(w.capitalize() for w in words), "_".join(words).upper(), f"{'_'.join(words)}_{rng.integers(1, 40)}")[i % 5]
        out.append(forms[int(rng.integers(len(forms)))].format(name))
    return out + [x for x in VOID_VALUES for _ in range(max(1, n // 50))]
