"""Small log fixtures: writers and builders shared by the tests."""
import json
import os


def write_lines(path, rows, end="\n", sep="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(sep.join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)
    return str(path)


def write_json(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f)
    return str(path)


def codex_meta(sid, ts="2026-02-13T11:00:00.000Z"):
    return {"timestamp": ts, "type": "session_meta", "payload": {"id": sid, "cwd": "/tmp/project", "cli_version": "0.1.0"}}


def codex_model(model, ts="2026-02-13T11:00:01.000Z"):
    return {"timestamp": ts, "type": "turn_context", "payload": {"model": model}}


def codex_count(total, last, window, ts):
    names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {
        "total_token_usage": dict(zip(names, total)), "last_token_usage": dict(zip(names, last)), "model_context_window": window}}}


def claude_usage(request, message, item, usage, model):
    i, c, r, m5, h1, o = usage
    return {"type": "assistant", "sessionId": "s", "uuid": message + request, "requestId": request, "message": {
        "model": model, "id": message, "role": "assistant", "content": [item], "usage": {
            "input_tokens": i, "cache_creation_input_tokens": c, "cache_read_input_tokens": r, "output_tokens": o,
            "cache_creation": {"ephemeral_5m_input_tokens": m5, "ephemeral_1h_input_tokens": h1}}}}


DOCUMENT = {
    "sessionId": "50641617-dd96-45e6-9649-0b711b8073ae", "projectHash": "31961e", "startTime": "2026-02-17T09:45:49.345Z",
    "lastUpdated": "2026-02-17T09:45:57.249Z", "messages": [
        {"id": "u1", "timestamp": "2026-02-17T09:45:49.345Z", "type": "user", "content": [{"text": "how is the weather?"}]},
        {"id": "a1", "timestamp": "2026-02-17T09:45:55.244Z", "type": "gemini", "content": "", "toolCalls": [
            {"id": "w-1", "name": "google_web_search", "args": {"query": "weather"}, "status": "success", "result": [
                {"functionResponse": {"id": "w-1", "name": "google_web_search", "response": {"output": "Cloudy"}}}]}],
         "thoughts": [{"text": "I should search first."}], "model": "gemini-3-flash-preview",
         "tokens": {"input": 12204, "output": 31, "cached": 0, "thoughts": 93, "tool": 0, "total": 12328}},
        {"id": "a2", "timestamp": "2026-02-17T09:45:57.249Z", "type": "gemini", "content": "Cloudy and cold.",
         "thoughts": [{"text": "Summarize."}], "model": "gemini-3-flash-preview",
         "tokens": {"input": 12727, "output": 48, "cached": 0, "thoughts": 42, "tool": 0, "total": 12817}}]}
