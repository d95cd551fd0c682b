"""Prompt templates of questions and of judges.

The template texts, verdict lists and names below are fixed values: results
only compare across runs if the wording is the same.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QaPrompt:
    content: str
    question_key: str = "question"
    context_key: str | None = None
    num_few_shot_examples: int | None = None


@dataclass(frozen=True)
class JudgePrompt:
    name: str
    content: str
    possible_answers: tuple[str, ...]  # descending priority
    system_prompt: str | None = None
    question_key: str = "question"
    predicted_answer_key: str = "predicted_answer"
    gold_answer_key: str = "gold_answer"
    separate_multi_answers: bool = False

    def unknown_priorities(self, verdicts: tuple[str, ...]) -> list[str]:
        """Priorities that are no allowed verdict; a non-empty list means the prompt contradicts itself."""
        return [p for p in self.possible_answers if p not in verdicts]


# fixed values: question prompts
QA_PROMPTS = {
    "short_zero_shot": QaPrompt(
        "Answer the following question as briefly as possible.\nQuestion: {question}\nAnswer:\n"
    ),
    "short_few_shot_sep": QaPrompt(
        """Answer the following question as briefly as possible.
Here are several examples:
Question: What is the capital of France?
Answer: Paris

Question: Who wrote *Romeo and Juliet*?
Answer: William Shakespeare

Question: What is the boiling point of water in Celsius?
Answer: 100°C

Question: How many continents are there on Earth?
Answer: Seven

Question: What is the fastest land animal?
Answer: Cheetah

Question: {question}
Answer:
"""
    ),
    "medium_zero_shot": QaPrompt(
        """Please provide a concise and direct response to the following question, keeping your answer as brief and to-the-point as possible while ensuring clarity. Avoid any unnecessary elaboration or additional details.
Question: {question}
Answer:
"""
    ),
    "medium_one_shot": QaPrompt(
        """Deliver a succinct and straightforward answer to the question below. Focus on being brief while maintaining essential information. Keep extra details to a minimum.

Here is an example:
Question: What is the Riemann hypothesis?
Answer: All non-trivial zeros of the Riemann zeta function have real part 1/2

Question: {question}
Answer:
"""
    ),
    "gsm8k": QaPrompt(
        """Given the following problem, reason and give a final answer to the problem.

Problem: {question}
Your response should end with "The final answer is [answer]" where [answer] is the response to the problem.
"""
    ),
}

# fixed values: judge prompts
JUDGE_PROMPTS = {
    "qa_eval": JudgePrompt(
        name="qa_eval",
        system_prompt="You are a Judge model comparing Predicted Answer to a given Question with Gold Answer.",
        content="""Evaluate the Predicted Answer compared to the Gold Answers and classify it as one of the following:
 - correct: The Predicted Answer fully matches the meaning of at least one of the Gold Answers. It is not necessary for all Gold Answers to match, as long as one does.
 - partial_correct: The Predicted Answer is somewhat accurate, but incomplete or contains minor errors, compared to at least one Gold Answer.
 - incorrect: The Predicted Answer does not match any of the Gold Answers or contains significant errors in comparison to all of them.
 - not_known: The Predicted Answer either refuses to answer or does not provide enough information to evaluate.

 Respond with exactly one word: 'correct', 'partial_correct', 'incorrect', or 'not_known'. No further explanation or context is needed.

 ====
 Question: '{{ question }}'
 Gold Answer '{{ gold_answer }}'
 Predicted Answer: '{{ predicted_answer }}'
 ====
 Assessment:
""",
        possible_answers=("correct", "partial_correct", "incorrect", "refuse"),
    ),
    "qa_orgad_et_al_eval": JudgePrompt(
        name="qa_orgad_et_al_eval",
        content="""You will evaluate answers to questions. For each question, I will provide a model's answer and one or more correct reference answers.
You would have to determine if the model answer is correct, incorrect, or model refused to answer. The model answer to be correct has to match from one to all of the possible correct answers.
If the model answer is correct, write 'correct' and if it is not correct, write 'incorrect'. If the Model Answer is a refusal, stating that they don't have enough information, write 'refuse'.
For example:

Question: who is the young guitarist who played with buddy guy?
Ground Truth: [Quinn Sullivan, Eric Gales]
Model Answer: Ronnie Earl
Correctness: incorrect

Question: What is the name of the actor who plays Iron Man in the Marvel movies?
Ground Truth: [Robert Downey Jr.]
Model Answer: Robert Downey Jr. played the role of Tony Stark/Iron Man in the Marvel Cinematic Universe films.
Correctness: correct

Question: what is the capital of France?
Ground Truth: [Paris]
Model Answer: I don't have enough information to answer this question.
Correctness: refuse

Question: who was the first person to walk on the moon?
Ground Truth: [Neil Armstrong]
Model Answer: I apologize, but I cannot provide an answer without verifying the historical facts.
Correctness: refuse

Question: {{question}}
Ground Truth: {{gold_answer}}
Model Answer: {{predicted_answer}}
Correctness:
""",
        possible_answers=("correct", "incorrect", "refuse"),
    ),
    "qa_multi_answers_eval_short": JudgePrompt(
        name="qa_multi_answers_eval_short",
        content="""We are assessing the quality of answers to the following question: {{ question }}
The following are expected answers to this  question: {{ gold_answer }}
The proposed answer is: {{ predicted_answer }}
Within the context of the question, does the proposed answer mean the same as any of the expected answers? Respond only with 'correct', 'incorrect' or 'not_known'.
""",
        possible_answers=("correct", "incorrect", "not_known"),
        separate_multi_answers=True,
    ),
}
