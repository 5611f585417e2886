"""Hand-labelled answers. CHOOSING sets the cutoffs of the label models. CHECKING, of other phrasing and languages, sets nothing, but
some functions were changed after a look at it. UNSEEN was written after all functions and measured without changing any.

All are fixed and small, so using them costs nothing at any size. No text is taken from a table.
"""

from __future__ import annotations

from typing import NamedTuple

BAKERY = "A bakery makes 120 rolls each morning and sells 81 of them before noon. How many rolls are left for the afternoon?"
TANK = "A tank holds 450 litres of water. Every hour 25 litres flow out and 10 litres flow in. After how many hours is the tank empty?"
GARDEN = "Der Garten von Frau Meier ist 18 Meter lang und 7 Meter breit. Wie groß ist seine Fläche, und wie lang ist der Zaun, der ihn umgibt?"
BUS = "Un autobús sale con 32 pasajeros. En la primera parada bajan 9 y suben 14. ¿Cuántos pasajeros lleva el autobús después de la parada?"
LINES = "Let a and b be positive integers such that a + b = 24 and a divides b. How many ordered pairs (a, b) are there, and what is the largest b?"


class Sample(NamedTuple):
    text: str | None
    question: str
    defects: frozenset
    tokens: int | None = None
    last_token: int | None = None


def _of(defects: str, question: str, *texts: str | None) -> list[Sample]:
    """Samples of the same labels; every second truncated one was cut by its backend before the end token."""
    cut = "truncated" in defects
    return [
        Sample(t, question, frozenset(defects.split()), None if t is None else 2 * len(t.split()) + 1, 3 if cut and k % 2 else 7) for k, t in enumerate(texts)
    ]


CHOOSING = [
    *_of("", BAKERY, "39", "Each morning there are 120 rolls and 81 are sold, so 120 - 81 = 39 rolls are left.", "We subtract the sold rolls.\nLeft: 120 - 81 = 39", "\\boxed{39}",
         "```python\ndef left():\n    return 120 - 81\n```", "<main>\nThe bakery keeps 39 rolls.\n</main>", BAKERY + "\n\nSubtracting, 120 - 81 gives 39 rolls.", "Sorry, my first try was wrong: the difference is 39, not 41.",
         "We cannot sell more than 120 rolls, so the answer stays below that; it is 39.", "1. Start with 120.\n2. Take 81 away.\n3. The result is 39.", "<a_f1>\nTake away 81.\n</a_f1>\n<main>\n39\n</main>"),
    Sample("39", BAKERY, frozenset(), 2, 3), Sample("Take 81 from 120. Answer: 39", BAKERY, frozenset(), 12, 3), Sample(
        "Rolls sold: 81 of 120.\nleft = 39",
        BAKERY,
        frozenset(),
        12,
        3,
    ),
    *_of(
        "",
        TANK,
        "The net loss is 15 litres an hour. 450 / 15 = 30, so it is empty after 30 hours.",
        "Net flow: 25 - 10 = 15\nTime: 450 / 15 = 30 h",
        "It does not help to look at single hours. The loss is 15 an hour and therefore the tank runs dry after 30 hours.",
    ),
    *_of(
        "",
        GARDEN,
        "Die Fläche beträgt 18 * 7 = 126 Quadratmeter, der Zaun ist 50 Meter lang.",
        "Fläche = 126",
        "Wir rechnen zuerst die Fläche aus. Sie ist 126, und der Umfang ist 50.",
    ),
    *_of("", BUS, "Bajan 9 y quedan 23. Después suben 14, así que lleva 37 pasajeros.", "32 - 9 + 14 = 37"),
    *_of(
        "empty",
        BAKERY,
        None,
        "",
        "  \n",
        "---",
        "<main></main>",
        "```python\n```",
        "n/a",
        "None",
        "\\boxed{ }",
        "\u200b\ufeff",
        "<a_f1>\n</a_f1>\n<main>\n</main>",
    ),
    *_of("refusal", BAKERY, "I cannot help with homework questions.", "I'm sorry, but I am not able to answer that.", "Unfortunately I have to decline.", "As an assistant I won't provide solutions to graded tasks.", "This request goes against my guidelines.",
         "```python\n# I refuse to solve this.\npass\n```", "<main>\nPlease ask your teacher, I would rather not respond.\n</main>", "Thank you for the question, but I must pass on this one."),
    *_of("refusal", GARDEN, "Diese Aufgabe kann ich leider nicht lösen.", "Ich lehne es ab, das zu beantworten."),
    *_of("refusal", BUS, "Lo siento, no puedo ayudar con esta tarea.", "Prefiero no responder a esta pregunta."),
    *_of(
        "copied_question",
        BAKERY,
        BAKERY,
        "Question: " + BAKERY,
        "<main>\n" + BAKERY.upper() + "\n</main>",
        BAKERY + " " + BAKERY,
        "The task says: a bakery makes 120 rolls each morning and sells 81 of them before noon. How many rolls are left?",
    ),
    *_of("copied_question", TANK, "- " + TANK.replace(". ", ".\n- "), TANK.replace("litres", "liters")),
    *_of("truncated", BAKERY, "Each morning there are 120 rolls, and before noon the shop sel", "We start with 120 rolls. Then we take away the", "<a_f1>\nWe start with 120 rolls.", "The morning starts with 120 rolls and the...", "```python\ndef left():\n    total = 120 -",
         "We have 120 rolls and sell 81 of them.\n<ma", "1. Start with 120 rolls.\n2.", "There are 120 rolls (of which", "We take 120 rolls, from them we subtract 81, [truncated]", "<main>\nThe remaining number of rolls is"),
    *_of("truncated", GARDEN, "Die Fläche beträgt 126 Quadratmeter, und der Umfang", "<a_f1>\nZuerst rechnen wir die Fläche aus."),
    *_of("other_language", BAKERY, "Am Morgen gibt es 120 Brötchen, davon werden 81 verkauft, also bleiben 39 übrig.", "Le matin il y a 120 petits pains, on en vend 81, donc il en reste 39 pour la suite.", "Утром было 120 булочек, продали 81, значит осталось 39.",
         "早上有120个面包，卖了81个，所以还剩39个。", "Por la mañana hay 120 panes y se venden 81, así que quedan 39 para la tarde."),
    *_of(
        "other_language",
        GARDEN,
        "The area is 126 square metres and the fence around it is 50 metres long.",
        "La surface est de 126 mètres carrés et la clôture mesure 50 mètres.",
    ),
]

CHECKING = [
    *_of("", BAKERY, "The shop bakes 120 rolls. It sells 81 of them before noon.\nLeft: 120 - 81 = 39", "I'm sorry for the long derivation. The shop bakes 120 and sells 81. There are 39 loaves left.", "Rolls for the afternoon: 39",
         "By noon 81 of 120 have gone; what stays on the shelf is 39 pieces.", "Subtraction does it: 120 take away 81 leaves thirty-nine (39).", "> 39", "**39**", "$39$", "So 39 rolls remain!", "Thanks for asking! Counting down from 120 by 81 we arrive at 39."),
    *_of(
        "",
        LINES,
        "Since a divides 24 - a, it divides 24. The divisors below 24 are 1, 2, 3, 4, 6, 8, 12, so there are 7 pairs and the largest b is 23. \u220e",
        "a must be a divisor of 24 other than 24 itself\n7 pairs, max b = 23",
        "We do not give all cases in full. There are 7 pairs and b is at most 23.",
    ),
    *_of(
        "",
        TANK,
        "t = 450/(25-10) = 30 hours",
        "```python\ndef hours(v, out, inn):\n    return v / (out - inn)\n```\nCalling hours(450, 25, 10) yields 30.0.",
    ),
    *_of("", BUS, "En la parada bajan 9 personas y suben otras 14; por eso al salir viajan 37 personas."),
    *_of("empty", LINES, "\t", "?", "<main>\n\n</main>", "TBD", "```\n\n```", "\u3000", "\\boxed{}"),
    *_of(
        "refusal",
        LINES,
        "That is not something I will assist with.",
        "Regrettably, giving solutions to exam questions isn't permitted, so I won't answer.",
        "I am unable to provide a response to this query.",
        "My apologies, I must abstain from answering.",
    ),
    *_of(
        "refusal other_language",
        BAKERY,
        "Je ne peux pas vous aider avec cet exercice.",
        "申し訳ありませんが、この質問にはお答えできません。",
        "عذرا، لا يمكنني الإجابة على هذا السؤال.",
    ),
    *_of("copied_question", LINES, LINES, "Problem statement: " + LINES.lower(), "```\n" + LINES + "\n```", LINES.replace("positive", "natural")),
    *_of(
        "truncated",
        LINES,
        "Because a divides b it also divides the sum, which is 24, and ther",
        "The divisors of 24 are 1, 2, 3 and",
        "<main>\nThere are 7 such pairs, since a is a",
        "def pairs():\n```python\nfor a in range(1, 24",
        "We count the divisors of 24 (without 24",
        "Counting the divisors we find\u2026",
    ),
    *_of("truncated", BUS, "Primero bajan nueve personas del autobús y luego suben las"),
    *_of("other_language", BAKERY, "Rano piekarnia ma 120 bułek, a przed południem sprzedaje 81 z nich, więc na popołudnie zostaje 39 bułek.", "في الصباح يوجد مئة وعشرون رغيفا ويباع منها واحد وثمانون قبل الظهر، لذلك يبقى تسعة وثلاثون رغيفا.",
         "De bakkerij maakt 120 broodjes en verkoopt er 81 van voor de middag, dus er zijn nog 39 broodjes over.", "Il fornaio prepara 120 panini e ne vende 81 prima di mezzogiorno, quindi ne restano 39 per il pomeriggio.", "パンは120個あり、81個売れたので、残りは39個です。"),
    *_of("other_language", BUS, "The bus starts with 32 people, 9 get off and 14 get on, so it carries 37 of them."),
]

TRAIN = "A train leaves Porto at 9:15 and arrives in Lisbon at 12:05. It stops for 20 minutes on the way. How long is it actually moving?"
ROOTS = "Find all real numbers x such that x^2 - 7x + 10 = 0, and give the sum of their squares."
MARCHE = "Au marché, Louise achète 3 kg de pommes à 2 euros le kilo et 4 kg de poires à 3 euros le kilo. Combien paie-t-elle en tout ?"

#: Written after the functions were settled. Most of its refusals are missed; a rule for them that was tried flagged good answers
#: and was taken back, so the functions are those from before this split.
UNSEEN = [
    *_of("", TRAIN, "From 9:15 to 12:05 are 170 minutes; minus the stop that makes 150 minutes, i.e. two and a half hours.", "170 min - 20 min = 150 min", "Moving time: 2 h 30 min", "We are not told the speed, but it isn't needed. The trip lasts 170 minutes and 150 of them are spent moving.",
         "```python\nprint((12 * 60 + 5) - (9 * 60 + 15) - 20)\n```", "I can offer a short way: 12:05 minus 9:15 is 2:50, and 2:50 minus 0:20 is 2:30.", "2.5 hours"),
    *_of("", ROOTS, "The equation factors as (x - 2)(x - 5) = 0. Hence x = 2 or x = 5 and the sum of squares is 4 + 25 = 29.", "x in {2, 5}, so 29.", "\\boxed{29}", "By Vieta: s = 7, p = 10, s^2 - 2p = 29", "<main>29</main>"),
    *_of("", MARCHE, "Les pommes coûtent 6 euros et les poires 12 euros, donc elle paie 18 euros.", "3 * 2 + 4 * 3 = 18", "Elle ne peut pas payer moins que 18 euros, et c'est exactement ce prix."),
    *_of("empty", TRAIN, "\n\n", ".", "<a_f1></a_f1>", "nil", "**"),
    *_of("refusal", TRAIN, "I'd prefer not to get into this one.", "Sorry, no can do.", "This is not a question that I am able to respond to.", "You should work this out on your own; I will not do it for you.", "Helping with graded coursework is something I don't do.",
         "I'll have to say no to that.", "Answering this would break the rules I follow.", "I don't do exams.", "That question is one I will leave to your tutor.", "My answer to this is: no answer.", "I have decided against solving it.",
         "I am afraid I must keep silent here.", "Not today, I am not in a position to calculate this.", "I never give away solutions to contests.", "Sorry, you will get no solution out of me."),
    *_of("", TRAIN, "I did not expect such a neat result, but the pattern repeats and the claim follows.", "I don't need calculus here; symmetry gives equality.", "Not every root is real, as I showed above.",
         "I would not use induction; the pigeonhole principle settles it."),
    *_of("refusal", MARCHE, "Je suis désolé, mais je ne peux pas répondre à cette question.", "Il m'est impossible de vous donner la solution."),
    *_of("copied_question", TRAIN, TRAIN, "> " + TRAIN, "Let me restate the problem. " + TRAIN, TRAIN.replace("Porto", "Porto Alegre")),
    *_of("copied_question", MARCHE, "Énoncé : " + MARCHE, MARCHE.upper()),
    *_of("truncated", TRAIN, "From 9:15 to 12:05 there are 170 minutes, and the train stands for", "First, the total travel time is 12:05 - 9:15 = 2 hours and 50 minu", "1. Total time: 170 minutes.\n2. Stop:", "<main>\nThe train moves for 150", "The total is (12 * 60 + 5) - (9 * 60 +", "```python\nstart = 9 * 60 + 15\nend = 12 * 60"),
    *_of("truncated", ROOTS, "Factoring gives (x - 2)(x - 5) = 0, which means that either x equals 2 or", "The sum of the squares can be found from Vieta's formulas, because"),
    *_of("other_language", TRAIN, "O comboio parte às 9:15 e chega às 12:05, por isso a viagem dura 170 minutos e o comboio anda 150 minutos.", "Tren saat 9:15'te kalkar ve 12:05'te varır, yani yolculuk 170 dakika sürer ve tren 150 dakika hareket eder.", "기차는 9시 15분에 출발하여 12시 5분에 도착하므로 150분 동안 움직입니다.", "Der Zug fährt 170 Minuten, davon steht er 20 Minuten, also ist er 150 Minuten in Bewegung."),
    *_of("other_language", MARCHE, "The apples cost 6 euros and the pears cost 12 euros, so she pays 18 euros in total."),
]
