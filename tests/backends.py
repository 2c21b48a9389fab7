"""Backends that misbehave; in a module of their own, so that executors can import them."""

from semspan.backends import Backend, Reply


class FailsOnThirteen(Backend):
    def answer(self, prompt, model):
        if any(v == "13" for _, _, v in prompt.items):
            raise TimeoutError
        return Reply(f"<output>{len(prompt.items)}</output>", 0.01)


class SecondTry(Backend):
    tried = set()

    def answer(self, prompt, model):
        if prompt not in self.tried:
            self.tried.add(prompt)
            raise TimeoutError
        return Reply("<output>x</output>")
