import pytest

from docstruct.llm.tokenize import BYTE_BPE_50K


@pytest.fixture(scope="session")
def vocab_path():
    import os

    if not os.path.exists(BYTE_BPE_50K):
        pytest.skip("no vocabulary file here")
    return BYTE_BPE_50K
