"""Table shapes the operators expect. Times of day are minutes, instants are whole seconds since the epoch (UTC)."""

VENUE_CONFIG = ("venue_id long, capacity int, slot_min int, days_ahead int, max_party int, max_per_phone int, max_per_hour int, "
                "max_email_addr_day int, max_email_hour int, max_changes_day int, team_contact string, tz string")
RESERVATIONS = ("reservation_id long, venue_id long, customer_id long, channel string, reservation_date date, reservation_min int, people int, "
                "zone string, status string, special_requests string, confirmation_code string, created_epoch long, email_sent_epoch long, email_to string")
BOOKING_REQUESTS = "request_id long, venue_id long, customer_id long, phone string, req_date date, req_min int, people int, request_epoch long"
CUSTOMERS = "customer_id long, channel string, channel_user_id string, name string, surname string, language string"
OPENING_HOURS = "venue_id long, opening_hours string"  # JSON: weekday -> [{open, close}]
SPECIAL_DATES = ("venue_id long, day date, kind string, title string, details string, booking_policy string, deposit_required boolean, "
                 "price_note string, guest_note string")
CHANGE_LOG = "reservation_id long, action string, created_epoch long"
CHANGE_COMMANDS = ("command_id long, venue_id long, code string, phone string, channel string, customer_id long, new_date string, new_time string, "
                   "new_people string, new_zone string, new_request string, command_epoch long")
CHAT_MESSAGES = "id long, session_id long, turn long, type string, content string, created_epoch long"
CASE_REQUESTS = "case_id long, session_key long, reason string, guest_contact string, epoch long"
