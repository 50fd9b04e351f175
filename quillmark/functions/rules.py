"""Keyword tables. All entries are fixed values; three tables for the same concepts differ on purpose."""

from __future__ import annotations

#: Facts for synthesising negatives. Each is a substring test on the lower-cased function.
GENERATOR_FACTS = {
    "access_control": ("onlyowner", "only owner", "hasrole", "msg.sender == owner", "msg.sender==owner", "owner()", "_owner", "admin", "authorized", "onlyadmin", "onlygovernance", "onlyoperator"),
    "time_constraint": ("block.timestamp", "block.number", "deadline", "locktime", "unlocktime", "timelock", "starttime", "endtime", "duration"),
    "fund_transfer": (".transfer(", ".send(", "call{value", "call.value", "ierc20", "safetransfer", "transferfrom", "approve", "allowance", "balance"),
    "external_call": (".call(", ".delegatecall(", ".staticcall(", "delegatecall", "interface", "callback", "onerc", "onerc721", "onerc1155"),
    "state_validation": ("require(", "require (", "revert(", "revert (", "assert(", "assert (", "modifier"),
    "emergency_control": ("paused", "pause", "unpause", "whenpaused", "whennotpaused", "blacklist", "whitelist", "emergency"),
    "unchecked_arithmetic": ("unchecked",),
    "mint": ("mint",),
    "burn": ("burn",),
    "approve_or_allowance": ("approve", "allowance", "spender"),
    "delegatecall": ("delegatecall",),
}

#: Facts for scoring coverage, in output order: what the function must contain, and what covers it in a comment.
COVERAGE_FACTS = {
    "access_control": (("onlyowner", "hasrole", "msg.sender == owner", "msg.sender==owner", "owner()", "_owner", "admin", "authorized", "auth"), ("owner", "admin", "role", "permission", "authorized", "only", "caller", "sender", "access")),
    "state_validation": (("require(", "revert(", "assert(", "modifier"), ("require", "revert", "assert", "check", "ensure", "validate", "must", "condition", "precondition", "only if", "when", "unless", "valid")),
    "time_constraint": (("block.timestamp", "block.number", "deadline", "locktime", "unlocktime", "time lock", "timelock", "starttime", "endtime", "duration", "period"), ("time", "deadline", "lock", "unlock", "timestamp", "block", "before", "after", "expired", "duration", "period", "start", "end")),
    "fund_transfer": ((".transfer(", ".send(", "call{value", "call.value", "safetransfer", "transferfrom", "transferfrom(", "transfer(", "approve(", "allowance", "ierc20", "erc20", "erc721"), ("transfer", "send", "fund", "funds", "eth", "ether", "token", "tokens", "approve", "approval", "allowance", "spender", "recipient", "receiver", "payment")),
    "external_interaction": ((".call(", ".delegatecall(", ".staticcall(", "delegatecall", "callback", "onerc", "interface", "oracle"), ("external", "call", "contract", "delegatecall", "staticcall", "callback", "receiver", "oracle", "interact", "interaction")),
    "authorization_logic": (("approve(", "allowance", "transferfrom", "permit"), ("approve", "approval", "allowance", "spender", "authorized", "permission", "permit", "transferfrom")),
    "emergency_control": (("paused", "pause", "unpause", "blacklist", "whitelist", "emergency"), ("pause", "paused", "unpause", "blacklist", "whitelist", "emergency", "disabled", "enabled", "blocked")),
    "unchecked_arithmetic": (("unchecked",), ("unchecked", "arithmetic", "overflow", "underflow")),
}

#: What a comment claims against what the function shows, in output order: flag, whether the function must have (True)
#: or lack (False) the evidence, the evidence, the claims. The bool return's evidence is a pattern besides.
CLAIM_FLAGS = (
    ("unsupported_access_control_claim", False, ("onlyowner", "hasrole", "msg.sender == owner", "msg.sender==owner", "owner()", "_owner", "admin", "authorized"), ("only the owner", "owner only", "only owner", "admin only", "only admin", "restricted to owner", "restricted to the owner")),
    ("contradict_time_constraint", True, ("block.timestamp", "block.number", "deadline", "locktime", "unlocktime", "timelock", "starttime", "endtime", "duration"), ("at any time", "anytime", "without time restriction", "no time restriction", "whenever")),
    ("contradict_state_validation", True, ("require(", "revert(", "assert(", "modifier"), ("without checking", "without any check", "without precondition", "no precondition", "without validation")),
    ("contradict_fund_transfer", True, (".transfer(", ".send(", "call{value", "call.value", "safetransfer", "transferfrom", "approve(", "allowance"), ("without transferring funds", "without transferring tokens", "does not transfer", "no fund transfer")),
    ("contradict_external_interaction", True, (".call(", ".delegatecall(", ".staticcall(", "delegatecall", "callback", "oracle"), ("without external interaction", "without external call", "only internal", "internal state updates only")),
    ("unsupported_reentrancy_guarantee", False, ("nonreentrant", "_status", "reentrancyguard"), ("prevents reentrancy", "reentrancy safe", "reentrancy-safe", "protects against reentrancy")),
    ("contradict_unchecked_arithmetic", True, ("unchecked",), ("complete overflow protection", "fully prevents overflow", "prevents overflow", "overflow safe")),
    ("unsupported_bool_return", False, ("returns (bool",), ("returns true", "return true")),
    ("unsupported_owner_permission_claim", False, ("onlyowner", "hasrole", "msg.sender == owner", "msg.sender==owner", "owner()", "_owner", "admin", "authorized"), ("owner can", "only owner", "only the owner", "owner may", "owner is able", "called by owner", "called by the owner", "can only be called by owner", "can only be called by the owner", "restricted to owner", "restricted to the owner")),
    ("unsupported_emergency_claim", False, ("pause", "paused", "unpause", "emergency", "blacklist", "whitelist"), ("case of emergency", "in emergency", "emergency situation", "emergency use")),
)
BOOL_RETURN = r"returns[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\([^)]*bool"

#: Negatives after the access rules, in output order: fact, source, perturbation, text.
FIXED_NEGATIVES = (
    ("time_constraint", "hard_negative_time_constraint", "time_constraint_omission", "Performs the operation at any time."),
    ("fund_transfer", "hard_negative_asset_flow_omission", "asset_flow_omission", "Updates internal records without transferring assets."),
    ("external_call", "hard_negative_external_call_omission", "external_call_omission", "Performs only internal state updates without external contract interaction."),
    ("state_validation", "hard_negative_validation_omission", "validation_omission", "Executes the operation without checking any preconditions."),
    ("emergency_control", "hard_negative_emergency_omission", "emergency_control_omission", "Executes the operation without considering paused or emergency states."),
    ("mint", "hard_negative_action_reverse", "mint_burn_reversal", "Burns tokens from the caller."),
    ("burn", "hard_negative_action_reverse", "mint_burn_reversal", "Mints new tokens to the caller."),
    ("approve_or_allowance", "hard_negative_approval_misread", "approval_as_transfer", "Transfers tokens directly to the spender."),
    ("delegatecall", "hard_negative_delegatecall_misread", "delegatecall_semantic_error", "Calls the implementation without preserving the caller context."),
    ("unchecked_arithmetic", "hard_negative_unchecked_arithmetic", "unchecked_arithmetic_hallucination", "Performs arithmetic operations with complete overflow protection."),
)
GENERIC_NEGATIVE = ("hard_negative_generic_incomplete", "generic_incomplete", "Executes the function.")
ANY_USER = "Allows any user to perform this operation."
GENERIC_SENTENCE = "Performs the requested operation."
REMOVED_TERMS = ("owner", "admin", "authorized", "only", "governance", "operator")

#: Comment validity.
FOREIGN_MARKERS = ("functie", "terug", "geeft", "fonction", "retourne", "función", "devuelve", "funktion", "gibt", "funzione", "restituisce")
ARTIFACTS = ("/**", "/*", "*/", "///", "//", "@param", "@return", "@returns", "@dev", "@notice", "```")
RETURN_ARTIFACTS = (" return ", " return the ", " return a ", " return an ", " returns uint", " return uint", " returns bool", " return bool", " returns string", " return string", " returns address", " return address", " representing the ")
TOO_GENERIC = ("executes the function", "execute the function", "performs the operation", "perform the operation", "performs the requested operation", "does something", "main function", "internal function", "external function")
BOILERPLATE = ("here is", "the comment is", "generated comment", "as an ai", "this function is used to")
#: Style.
TEMPLATE_PHRASES = ("here is", "this comment", "the comment is", "generated comment", "as an ai")
