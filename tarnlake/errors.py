"""Errors with the codes that callers know."""


class EngineError(Exception):
    code, kind = -32099, "internal"


class InvalidParams(EngineError):
    code, kind = -32001, "invalid_params"


class NotFound(EngineError):
    code, kind = -32002, "not_found"


class Ambiguous(EngineError):
    code, kind = -32003, "ambiguous"


class ResourceExhausted(EngineError):
    code, kind = -32004, "resource_exhausted"
