import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from casewise.config import REQUIRED_COLUMNS  # noqa: E402
from casewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "casewise-tests")


@pytest.fixture(scope="session")
def make_records(spark):
    def make(rows):
        """Records from (id, text, macro, detail) tuples."""
        full = [(str(i), text, "email", "2026-04-04", macro, detail) for i, text, macro, detail in rows]
        return spark.createDataFrame(full, ", ".join(f"{name} string" for name in REQUIRED_COLUMNS))

    return make


TRAIN_8 = [
    (1, "Erro no login do sistema", "Suporte", "Login"),
    (2, "Nao consigo acessar a conta", "Suporte", "Login"),
    (3, "Preciso redefinir minha senha", "Suporte", "Senha"),
    (4, "Falha ao anexar arquivo no chamado", "Suporte", "Anexo"),
    (5, "Preciso da segunda via do boleto", "Financeiro", "Boleto"),
    (6, "Cobranca duplicada na fatura do mes", "Financeiro", "Cobranca"),
    (7, "Atualizar telefone do cadastro", "Cadastro", "Atualizacao"),
    (8, "Corrigir endereco do cliente", "Cadastro", "Endereco"),
]


@pytest.fixture(scope="session")
def train_8(make_records):
    return make_records(TRAIN_8)
