"""Hints by language; English stands in for an unknown one."""

from __future__ import annotations

_HINTS = {
    "en": {
        "wrapper-duplicate": "Two thin wrappers do the same; keep one.",
        "style-duplicate": "The styles nearly agree; share them.",
        "logic-duplicate": "The logic overlaps; move it to one place.",
        "copy-paste-variant": "This looks like a copy; merge the two.",
        "prop-parameterizable": "One component with a parameter would do.",
        "forked-clone": "One side has grown from the other; check whether both are needed.",
    },
    "es": {
        "wrapper-duplicate": "Dos envoltorios finos hacen lo mismo; deje uno.",
        "style-duplicate": "Los estilos casi coinciden; compártalos.",
        "logic-duplicate": "La lógica se repite; llévela a un solo lugar.",
        "copy-paste-variant": "Parece una copia; una las dos.",
        "prop-parameterizable": "Bastaría un componente con un parámetro.",
        "forked-clone": "Una parte creció a partir de la otra; compruebe si hacen falta ambas.",
    },
    "fr": {
        "wrapper-duplicate": "Deux enveloppes minces font la même chose ; gardez-en une.",
        "style-duplicate": "Les styles concordent presque ; partagez-les.",
        "logic-duplicate": "La logique se recoupe ; mettez-la à un seul endroit.",
        "copy-paste-variant": "On dirait une copie ; fusionnez les deux.",
        "prop-parameterizable": "Un seul composant avec un paramètre suffirait.",
        "forked-clone": "L'un est issu de l'autre et a grandi ; vérifiez s'il faut les deux.",
    },
    "de": {
        "wrapper-duplicate": "Zwei dünne Hüllen tun dasselbe; eine genügt.",
        "style-duplicate": "Die Stile stimmen fast überein; nutzen Sie sie gemeinsam.",
        "logic-duplicate": "Die Logik überschneidet sich; legen Sie sie an eine Stelle.",
        "copy-paste-variant": "Das sieht nach einer Kopie aus; führen Sie beide zusammen.",
        "prop-parameterizable": "Eine Komponente mit einem Parameter würde genügen.",
        "forked-clone": "Das eine ist aus dem anderen gewachsen; prüfen Sie, ob es beide braucht.",
    },
    "ru": {
        "wrapper-duplicate": "Две тонкие обёртки делают одно и то же; оставьте одну.",
        "style-duplicate": "Стили почти совпадают; сделайте их общими.",
        "logic-duplicate": "Логика повторяется; перенесите её в одно место.",
        "copy-paste-variant": "Похоже на копию; объедините обе части.",
        "prop-parameterizable": "Хватило бы одного компонента с параметром.",
        "forked-clone": "Одно выросло из другого; проверьте, нужны ли оба.",
    },
    "zh": {
        "wrapper-duplicate": "两个薄封装作用相同，保留一个即可。",
        "style-duplicate": "样式几乎一致，应当共用。",
        "logic-duplicate": "逻辑重叠，请放到同一处。",
        "copy-paste-variant": "看起来像复制品，请合并两者。",
        "prop-parameterizable": "一个带参数的组件就够了。",
        "forked-clone": "其中一个由另一个演变而来，请确认是否都需要。",
    },
}
LANGUAGES = tuple(_HINTS)


def resolve(language: str | None) -> str:
    """The part before - or _ if it is known, else English."""
    short = (language or "en").lower().replace("_", "-").split("-")[0]
    return short if short in _HINTS else "en"


def hints(language: str | None = "en") -> dict[str, str]:
    return _HINTS[resolve(language)]
